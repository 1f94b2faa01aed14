"""Each stage of the pipeline against plain code on its own input."""

import collections

import pytest

import corpus_pipeline
from tests.llm.conftest import rows_of
from tests.llm.test_operators import brute_contamination, brute_fingerprint, brute_ids
from vacancia.llm import mixing, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, docs, corpus_pipeline.stored(stage(spark, docs, SF), "test")))
        docs = out[-1][2]
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_columns_and_order(steps):
    assert [x[0] for x in steps] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_output"]
    assert all(after.schema.names == before.schema.names for _, before, after in steps[:-1])


def test_quality_stage(spark, steps):
    _, before, after = steps[0]
    scored = quality.classify(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(after) == {r["doc_id"] for r in scored.filter("predicted = 1").collect()}


def test_dedup_stage(steps):
    _, before, after = steps[1]
    rows = sorted((r["doc_id"], brute_fingerprint(r["text"])) for r in before.collect())
    group = {i: i for i, _ in rows}
    for i, f in rows:
        for j, g in rows:
            if j < i and (f ^ g).bit_count() <= 3:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if v == old else v for k, v in group.items()}
    assert ids(after) == set(group.values())


def test_decontamination_stage(spark, steps):
    _, before, after = steps[2]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = brute_contamination([(r["doc_id"], r["text"]) for r in before.collect()], items)
    assert ids(after) == {r[0] for r in found if not r[5]}


def test_mixing_stage(steps):
    _, before, after = steps[3]
    wanted = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(before).collect() if r["taken"]}
    assert collections.Counter(r["doc_id"] for r in after.collect()) == wanted
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert all(texts[r["doc_id"]] == r["text"] for r in after.collect())


def test_token_stage(steps):
    _, before, after = steps[4]
    assert rows_of(after) == sorted(brute_ids([(r["doc_id"], r["text"]) for r in before.collect()]), key=repr)


def test_awkward_documents(spark, awkward, clashing, nothing):
    for docs in (clashing, nothing):
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stored(stage(spark, docs, SF), "test")
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and docs.count() == 0


def test_rows_are_told_apart(spark):
    item = next(r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len((r["text"] or "").split()) >= 12)
    clean = [" ".join(f"{w}{i}" for i in range(40)) for w in "abc"]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    run = lambda stage, rows: rows_of(stage(spark, spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], schema), SF), "doc_id", "text")
    rows = [(None, clean[0], "s"), (None, item, "s"), (7, clean[1], "s"), (7, item, "s")]
    assert run(corpus_pipeline.decontamination, rows) == sorted([(None, clean[0]), (7, clean[1])], key=repr)
    # copies without an id, copies of one id, and an id that stands for one group and belongs to another
    rows = [(None, clean[0], "s"), (None, clean[0], "s"), (5, clean[1], "s"), (5, clean[1], "s"), (5, clean[2], "s"), (3, clean[2], "s"), (None, clean[2], "s")]
    assert run(corpus_pipeline.near_dedup, rows) == sorted([(None, clean[0]), (5, clean[1]), (3, clean[2])], key=repr)


def test_mix_counts_rows_of_one_id(spark):
    rows = [(7, " ".join(["w"] * n), "en", s, 1) for s, sizes in (("a", (3, 4, 5, 6)), ("b", (5, 6, 7, 8, 9)), ("c", (2, 3, 10))) for n in sizes]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    wanted = collections.Counter()
    for r in mixing.mix(docs).collect():
        wanted[r["size"]] += r["taken"] // r["size"]
    got = collections.Counter(len(r["text"].split()) for r in corpus_pipeline.mix_sources(spark, docs, SF).collect())
    assert got == +wanted and sum(n * k for n, k in got.items()) <= sum(len(r[1].split()) for r in rows)
