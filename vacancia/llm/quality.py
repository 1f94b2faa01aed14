"""Document quality by attention-based multiple-instance learning over passages.

A document is a bag of passages. Each passage is encoded; gated attention, learnt from labels of whole
documents, weighs the codes; the weighted sum is scored. Training is numpy on a bounded sample, scoring a
map over all documents.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSAGE = 64  # words
SAMPLE = 2000  # training documents of each label
BIGRAMS = 48  # buckets for pairs of neighbouring bytes
HIDDEN, GATE, EPOCHS, BATCH, RATE, DECAY = 24, 12, 30, 64, 0.01, 1e-4

_GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r", "\t\x0b\x0c", ".", ",", "!", "?", "|", "#$%&*@^~", "()[]{}<>", "/\\_=+", ":;-", "'\"`"]
_CLASSES = len(_GROUPS) + 2  # the other ASCII bytes, and all bytes beyond ASCII
_CLASS = np.full(256, len(_GROUPS), np.int64)
_CLASS[128:] = len(_GROUPS) + 1
for _i, _group in enumerate(_GROUPS):
    _CLASS[list(_group.encode())] = _i
_BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
FEATURES = _CLASSES + BIGRAMS + 4


def passage_features(text: str) -> np.ndarray:
    """A row for each passage of PASSAGE words (one zero row for a text without words)."""
    data = text.encode()
    words = data.split()
    if not words:
        return np.zeros((1, FEATURES), np.float32)
    raw = np.frombuffer(data, np.uint8)
    blank = _BLANK[raw]
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))[::PASSAGE]
    n = len(starts)
    sizes = np.diff(np.append(starts, len(raw)))
    sizes[0] += starts[0]
    of = np.repeat(np.arange(n), sizes)
    classes = np.bincount(of * _CLASSES + _CLASS[raw], minlength=n * _CLASSES).reshape(n, _CLASSES)
    wide = raw.astype(np.int64)
    bigrams = np.bincount(of[1:] * BIGRAMS + (wide[:-1] * 131 + wide[1:] * 31) % BIGRAMS, minlength=n * BIGRAMS).reshape(n, BIGRAMS)
    at = np.arange(0, len(words), PASSAGE)
    count = np.diff(np.append(at, len(words)))
    length = np.add.reduceat(np.fromiter(map(len, words), np.int64, len(words)), at) / count
    again = np.zeros(len(words), np.int64)
    again[1:] = np.fromiter(map(operator.eq, words[1:], words), bool, len(words) - 1)
    distinct = [len(set(words[i : i + PASSAGE])) for i in at.tolist()]
    more = [np.minimum(length, 50) / 10, np.add.reduceat(again, at) / count, np.array(distinct) / count, np.log1p(count) / 4]
    return np.hstack([classes / sizes[:, None], bigrams / sizes[:, None], np.stack(more, axis=1)]).astype(np.float32)


@dataclass
class Model:
    """Weights of encoder (w, b), attention (v, u, a) and scorer (c, d); mean and scale of the features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        """Everything between passages x (bags begin at rows `at`) and the score p of each bag."""
        w = self.weights
        size = np.diff(np.append(at, len(x)))
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ w["w"] + w["b"])
        t, g = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
        e = (t * g) @ w["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), size))
        attention = e / np.repeat(np.add.reduceat(e, at), size)
        z = np.add.reduceat(attention[:, None] * h, at)
        p = 1 / (1 + np.exp(-(z @ w["c"] + w["d"])))
        return {"x": x, "h": h, "t": t, "g": g, "attention": attention, "z": z, "p": p, "size": size}

    def gradients(self, x: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.weights, self.forward(x, at)
        size, attention, h, t, g = f["size"], f["attention"], f["h"], f["t"], f["g"]
        out = (f["p"] - y) * weight
        z = np.repeat(out, size)[:, None] * w["c"]
        to_attention = (h * z).sum(axis=1)
        e = attention * (to_attention - np.repeat(np.add.reduceat(attention * to_attention, at), size))
        gated = e[:, None] * w["a"]
        to_t, to_g = gated * g * (1 - t * t), gated * t * g * (1 - g)
        to_h = (attention[:, None] * z + to_t @ w["v"].T + to_g @ w["u"].T) * (1 - h * h)
        return {"w": f["x"].T @ to_h, "b": to_h.sum(axis=0), "v": h.T @ to_t, "u": h.T @ to_g, "a": (t * g).T @ e, "c": f["z"].T @ out, "d": out.sum()}


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model | None:
    """Adam on cross entropy in which both labels weigh the same; None without bags."""
    if not bags:
        return None
    every, rng = np.concatenate(bags).astype(np.float64), np.random.default_rng(seed)
    start = {"w": (FEATURES, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "d": ()}
    weights = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k in "wvuac" else np.zeros(s) for k, s in start.items()}
    model = Model(every.mean(axis=0), every.std(axis=0) + 1e-3, weights)
    share = np.array([max(1, (labels == k).sum()) for k in (0, 1)]) / len(labels)
    first, second = ({k: np.zeros(s) for k, s in start.items()} for _ in range(2))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), BATCH):
            chosen = order[i : i + BATCH]
            x = np.concatenate([bags[j] for j in chosen]).astype(np.float64)
            at = np.concatenate([[0], np.cumsum([len(bags[j]) for j in chosen])[:-1]])
            y = labels[chosen]
            grads = model.gradients(x, at, y, 0.5 / share[y] / len(chosen))
            step += 1
            for k, grad in grads.items():
                grad = grad + DECAY * weights[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                weights[k] = weights[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def training_bags(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of at most `sample` documents of each label, the first by a hash of doc_id, none held out.

    A document's bag has all its passages; the number of documents is what bounds the driver's memory (280
    bytes a passage, five times that while learning begins).
    """
    known = labels.select("doc_id", "quality").filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    parts = [known.filter(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    chosen = parts[0].union(parts[1]).withColumnRenamed("doc_id", "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [passage_features(text.as_py() or "") for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([x.tobytes() for x in rows])], ["doc_id", "quality", "bag"])

    # 2 * sample rows of two numbers at most are broadcast.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    texts = texts.select("doc_id", "text", F.col("quality").cast("int").alias("quality"))
    rows = sorted(texts.mapInArrow(run, "doc_id long, quality int, bag binary").collect(), key=lambda r: (r["doc_id"], bytes(r["bag"])))
    return [np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in rows], np.array([r["quality"] for r in rows], int)


def score(text: str, model: Model | None) -> Column:
    """Score of a text column, each text taken whole."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        first = np.zeros(1, int)
        bags = (passage_features(t.as_py() or "") for t in texts)
        return pa.array([0.5 if model is None else float(model.forward(x, first)["p"][0]) for x in bags], pa.float64())

    return run(F.col(text))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= 0.5): one row per row of `docs`.

    Only the text is an input of a score. Labels are learnt from rows whose crc32(doc_id as text) mod 3 is
    not 1, at most `sample` of each label, each with all its passages; a label other than 0 or 1, or null, is ignored, of several labels
    of one id the largest counts.

    A null text is scored as the empty one: one passage without features. Null doc_ids are never learnt from
    and count as the id "" for `held_out`. Without any label all scores are 0.5. Extra columns are not read.
    """
    model = fit(*training_bags(docs, labels, sample))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), score("text", model).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
