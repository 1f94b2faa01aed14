import zlib

import numpy as np
import pytest

from vacancia.llm import quality

SF = "/root/testdata/sf0.01"


def test_gradients():
    rng = np.random.default_rng(0)
    bag = lambda n: rng.normal(size=(n, quality.FEATURES)).astype(np.float32)
    model = quality.fit([bag(3), bag(2)], np.array([0, 1]))
    x, at, y, weight = rng.normal(size=(5, quality.FEATURES)), np.array([0, 3]), np.array([1, 0]), np.array([0.7, 0.3])

    def loss():
        p = model.forward(x, at)["p"]
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    for name, grad in model.gradients(x, at, y, weight).items():
        kept = model.weights[name]
        step = np.zeros(kept.shape)
        step[tuple(0 for _ in kept.shape)] = 1e-6
        model.weights[name] = kept + step
        above = loss()
        model.weights[name] = kept - step
        below = loss()
        model.weights[name] = kept
        assert (above - below) / 2e-6 == pytest.approx(grad[tuple(0 for _ in kept.shape)], abs=1e-6)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [(got[x["doc_id"]], x["quality"]) for x in labels.collect() if got[x["doc_id"]]["held_out"]]
    assert sum(r["predicted"] == q for r, q in held) / len(held) > 0.95
    shuffled = docs.selectExpr("doc_id", "text", "'x' AS lang", "'y' AS source")
    assert {r["doc_id"]: r["score"] for r in quality.classify(shuffled, labels).collect()} == {i: r["score"] for i, r in got.items()}


def test_edges(spark, awkward, clashing, nothing):
    labels = spark.createDataFrame([(1, 1, None), (2, 1, 0), (3, 0, 0), (4, 0, 0), (5, None, 0), (6, 7, 1), (None, 1, 1), (8, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(clashing, labels).collect()
    assert len(got) == awkward.count() and all(0 <= r["score"] <= 1 for r in got)
    empty = {r["score"] for r in got if r["doc_id"] in (3, 4)}
    assert len(empty) == 1
    assert {r["score"] for r in quality.classify(awkward, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(nothing, labels).count() == 0


def test_long_documents_are_learnt_whole(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(500 * quality.PASSAGE)))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(1, 9)], "doc_id long, quality int")
    named = docs.crossJoin(spark.range(1, 9)).selectExpr("id AS doc_id", "text")
    bags, _ = quality.training_bags(named, labels)
    assert bags and all(len(x) == 500 for x in bags)
