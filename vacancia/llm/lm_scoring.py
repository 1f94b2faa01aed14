"""Stupid-backoff scores of documents under the bigrams of the whole corpus.

Texts are hashed once, into pieces of about PIECE_WORDS words. A piece asks for the counts of its distinct words and pairs,
cut by ranges of hashes; Spark brings the questions of a range together, sums them and brings the answers
back to their piece, which scores its words. A row is a piece or a piece's share of a range, never a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancia.llm.common import ARROW_ROWS, discard, stored
from vacancia.llm.wordhash import word_hashes

BACKOFF = 0.4
LEAST = 2  # a pair of words seen less often gives no evidence: its second word is scored alone
SLICES = 4  # hash ranges of pairs, counted one after another: shuffles hold one at a time
PIECE_WORDS = 1 << 18  # words of a piece: a few megabytes in a task
RANGE_KEYS = 1 << 20  # distinct words or pairs, those of each piece by themselves, that a range has on average
PIECES_AT_ONCE = 16  # that a task holds: in Arrow batches, which are else counted for documents
WORDS = -1  # stands for the number of a slice where words are counted and not pairs
START = np.uint64(xxhash.xxh64_intdigest(b""))  # stands before a document's first word; no word is empty

PIECE = "docs array<long>, sizes array<int>, words binary, at binary, n_words long, n_distinct long"
ASKED = "part int, piece long, range int, keys binary, n binary"
TOTALS = "part int, piece long, range int, totals binary"
SUMS = "doc_id long, n_words long, part double"


def _hashed(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Hashes of each document's words, A-Z as a-z."""
    return [word_hashes((text.as_py() or "").encode().lower()) for text in batch.column("text")]


def _pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return before ^ ((word << np.uint64(1)) | (word >> np.uint64(63)))


def _slice(pair: np.ndarray, slices: int) -> np.ndarray:
    return (pair >> np.uint64(17)) % np.uint64(slices)


def _array(data, kind) -> np.ndarray:
    return np.frombuffer(data.as_py() if isinstance(data, pa.Scalar) else data, kind)


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones and so on: small numbers compress to little that way."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _from_planes(data, kind) -> np.ndarray:
    return np.ascontiguousarray(_array(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def pieces(docs: DataFrame, most: int) -> DataFrame:
    """The words of `docs`, hashed, in pieces of at most `most` places that may end within a document.

    docs, sizes: the documents of a piece and how many of its places each has; words: the distinct hashes, sorted;
    at: for each place the index of its word, and before them that of the word or START in front of the piece. Every
    document has one place for START, then its words; one without words has no place.
    """
    schema = pa.schema([("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("words", pa.binary()), ("at", pa.binary()), ("n_words", pa.int64()), ("n_distinct", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = _hashed(batch)
            ids = batch.column("doc_id").to_pylist()
            if not ids:
                continue
            stream = np.concatenate([[START], *[x for h in hashes if len(h) for x in ([START], h)]]).astype(np.uint64)
            row = np.repeat(np.arange(len(ids)), [len(h) + (len(h) > 0) for h in hashes])
            cuts = np.linspace(0, len(row), max(1, -(-len(row) // most)) + 1).astype(np.int64)
            first = [0, *[int(row[cut]) for cut in cuts[1:-1]], len(ids) - 1]
            for k in range(len(cuts) - 1):
                here = row[cuts[k] : cuts[k + 1]]
                last = max(first[k + 1], int(here[-1]) if len(here) else 0)
                words, at = np.unique(stream[cuts[k] : cuts[k + 1] + 1], return_inverse=True)
                sizes = np.bincount(here - first[k], minlength=last - first[k] + 1).astype(np.int32)
                n_words = int(np.count_nonzero(words[at[1:]] != START))
                yield _rows([(ids[first[k] : last + 1], sizes, words.tobytes(), _planes(at.astype(np.uint32)), n_words, len(words))], schema)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(texts.mapInArrow(run, PIECE).withColumn("piece", F.monotonically_increasing_id()), "lm-pieces", "zstd")


def asked(found: DataFrame, part: int, slices: int, ranges: int) -> DataFrame:
    """The distinct keys of each piece, sorted, with their counts in it, cut by range: those of its words or of one slice of its pairs."""
    schema = pa.schema([("part", pa.int32()), ("piece", pa.int64()), ("range", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, words, at in zip(*(batch.column(c) for c in ("piece", "words", "at"))):
                words, at = _array(words, np.uint64), _from_planes(at, np.uint32)
                if part == WORDS:
                    keys, n = words, np.bincount(at[1:], minlength=len(words))
                else:
                    pair = _pair(words[at[:-1]], words[at[1:]])
                    keys, n = np.unique(pair[(words[at[1:]] != START) & (_slice(pair, slices) == part)], return_counts=True)
                ends = np.searchsorted((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1))
                n = n.astype(np.uint32)
                rows = [(part, piece.as_py(), r, keys[s:e].tobytes(), _planes(n[s:e])) for r, (s, e) in enumerate(zip(ends, ends[1:])) if s < e]
                yield _rows(rows, schema)

    return found.select("piece", "words", "at").mapInArrow(run, ASKED)


def _summed(rows: pa.Table) -> pa.Table:
    """What all pieces count of each key of a range, told to each piece in the order of its keys."""
    keys = [_array(k, np.uint64) for k in rows.column("keys")]
    every, n = np.concatenate(keys), np.concatenate([_from_planes(c, np.uint32) for c in rows.column("n")])
    order = np.argsort(every, kind="stable")  # runs are sorted already
    ordered = every[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sums = np.add.reduceat(n[order].astype(np.int64), starts)
    totals = np.empty(len(every), np.int64)
    totals[order] = np.repeat(sums, np.diff(np.append(starts, len(every))))
    ends = np.cumsum([len(k) for k in keys])
    told = [_planes(totals[e - len(k) : e]) for k, e in zip(keys, ends)]
    return rows.select(["part", "piece", "range"]).append_column("totals", pa.array(told, pa.binary()))


def totals(found: DataFrame, part: int, slices: int, ranges: int) -> DataFrame:
    """part, piece, range, totals: the corpus' count of each key that `asked` gives, in its order."""
    return stored(asked(found, part, slices, ranges).groupBy("range").applyInArrow(_summed, TOTALS), "lm-totals", "zstd")


def _scores(total: int, least: int, slices: int):
    """The function that scores one piece from the answers to it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        words, at = _array(left.column("words")[0], np.uint64), _from_planes(left.column("at")[0], np.uint32)
        ids, sizes = left.column("docs")[0].as_py(), np.array(left.column("sizes")[0].as_py())
        answers: dict[int, list] = {}
        for part, _, told in sorted(zip(*(right.column(c).to_pylist() for c in ("part", "range", "totals"))), key=lambda r: r[:2]):
            answers.setdefault(part, []).append(_from_planes(told, np.int64))
        single = np.concatenate(answers[WORDS])
        real = words[at[1:]] != START
        before, word = at[:-1][real], at[1:][real]
        pair = _pair(words[before], words[word])
        both = np.empty(len(pair), np.int64)
        parts = _slice(pair, slices)
        for i in range(slices):
            here = parts == i
            if here.any():
                both[here] = np.concatenate(answers[i])[np.unique(pair[here], return_inverse=True)[1]]
        score = np.log(np.where(both >= least, both / single[before], BACKOFF * single[word] / float(total)))
        row = np.repeat(np.arange(len(ids)), sizes)[real]
        n = np.bincount(row, minlength=len(ids)).astype(np.int64)
        return pa.table([pa.array(ids, pa.int64()), n, np.bincount(row, score, len(ids)).astype(np.float64)], ["doc_id", "n_words", "part"])

    return run


def score_documents(docs: DataFrame, least: int = LEAST, slices: int = SLICES, piece_words: int = PIECE_WORDS, range_keys: int = RANGE_KEYS) -> DataFrame:
    """doc_id, n_words, log_score (sum over words, 4 decimals), mean_log_score (per word, null without words).

    A word w after v scores c(v w) / c(v) if the corpus has that pair `least` times or more, else BACKOFF
    times c(w) / all words. Counts are over all of `docs`, A-Z as a-z. Words and pairs are known by 64-bit
    hashes, so two that collide share a count. The order is two words; with `least` above 1 rarer pairs give
    no evidence (1 takes every pair, as stupid backoff does). No row or word is left out or sampled.
    `piece_words` and `range_keys` bound what a task holds at once and change no score.

    Null and blank texts have no words and score 0. Rows that share a doc_id (null is one id) are summed
    into one result row; words of different rows never form a pair. Extra columns are not read.
    """
    spark = docs.sparkSession
    found = pieces(docs, piece_words)
    size = found.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_words", "n_distinct")]).first()
    ranges = lambda keys: max(1, -(-keys // range_keys))
    run = _scores(max(size["n_words"], 1), least, slices)
    rows = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(PIECES_AT_ONCE))
    try:
        answers = [totals(found, WORDS, slices, ranges(size["n_distinct"]))]
        answers += [totals(found, i, slices, ranges(size["n_words"] // slices)) for i in range(slices)]
        told = reduce(DataFrame.unionByName, answers)
        sums = stored(found.groupBy("piece").cogroup(told.groupBy("piece")).applyInArrow(run, SUMS), "lm-sums")
    finally:
        spark.conf.set(ARROW_ROWS, rows)
    for table in (found, *answers):
        discard(table)
    every = sums.groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("part").alias("part"))
    mean = F.when(F.col("n_words") > 0, F.round(F.col("part") / F.col("n_words"), 4))
    return every.select("doc_id", "n_words", (F.round("part", 4) + 0.0).alias("log_score"), mean.alias("mean_log_score"))
