"""Spelling variants: words one edit apart, found by PartEnum signatures of their letter multisets.

A word's letters, each with the number of times it stood before, are the set dimensions of a binary vector.
One replaced letter changes two dimensions, one inserted or deleted letter changes one. The dimensions are
cut into parts; words within k changed dimensions agree on all but k parts at least, so they share one of
the signatures that name all but k of the parts (k = 2 of 4 parts for words of one length, 1 of 2 for
lengths one apart). One edit also leaves the first or the last half of a word as it is, so a signature
carries one of the halves. Words that share a signature are joined and verified. A signature of more than
BUCKET words is joined on hashes of the words with one letter taken out, which loses no pair.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.llm.common import discard, stored

EVERY = 97  # of the (document, word) hashes those this number divides lose a letter
LEAST_LENGTH, LEAST_COUNT, FACTOR = 5, 3, 2
BUCKET = 64  # a signature of more words is split by their deletion variants
LONG = 64  # pairs with a word of more letters are compared in Python, in time of their length and not its square
HELD = 4 << 20  # characters of words a task counts before it passes the counts on

_RUN = re.compile("[a-zÀ-ÿ]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words_of(doc_id: int | None, text: str | None) -> Counter:
    """Runs of letters with A-Z as a-z, some with one letter missing, and how often each occurs."""
    found, out = Counter(_RUN.findall((text or "").encode().lower().decode())), Counter()
    ahead = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in found.items():
        h = zlib.crc32(word.encode(), ahead)
        if h % EVERY == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        out[word] += n
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n of every word of the corpus that is long and frequent enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = Counter(), 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                for word, n in words_of(doc_id, text.as_py()).items():
                    if len(word) >= LEAST_LENGTH:
                        size += 0 if word in total else len(word)
                        total[word] += n
                if size > HELD:
                    yield out()
                    total.clear()
                    size = 0
        if total:
            yield out()

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Letters:
    """Letters of many words in a row, with sums that give a hash of any piece of a word."""

    def __init__(self, words: list[str]):
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.row = np.repeat(np.arange(len(words)), self.sizes)
        self.place = np.arange(len(self.codes)) - self.starts[self.row]
        longest = int(self.sizes.max(initial=0)) + 2
        self.up, self.down = np.ones(longest, np.uint64), np.ones(longest, np.uint64)
        self.up[1:], self.down[1:] = _BASE, _INVERSE
        self.up, self.down = np.multiply.accumulate(self.up), np.multiply.accumulate(self.down)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(self.codes + np.uint64(1)) * self.up[self.place], dtype=np.uint64)])

    def piece(self, first: np.ndarray, behind: np.ndarray) -> np.ndarray:
        """Hash of the letters from `first` up to `behind` of each word, the same wherever they stand in it."""
        return (self.sums[self.starts + behind] - self.sums[self.starts + first]) * self.down[first]

    def dimensions(self) -> np.ndarray:
        """Hash of (letter, how many of it stand before) of every letter; per word a set."""
        order = np.lexsort((self.codes, self.row))
        codes, row = self.codes[order], self.row[order]
        first = np.concatenate([[True], (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])])
        rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        out = np.empty(len(order), np.uint64)
        out[order] = _mix(codes * _BASE + rank.astype(np.uint64))
        return out

    def part_sums(self, parts: int) -> list[np.ndarray]:
        """For each part, the sum over each word of the dimensions that fall into it."""
        dims = self.dimensions()
        part = (_mix(dims * _BASE) >> np.uint64(40)) % np.uint64(parts)
        return [np.add.reduceat(np.where(part == p, dims, np.uint64(0)), self.starts) for p in range(parts)]

    def deletions(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of every word as it is and with one letter taken out, once for each run of the same letter."""
        whole = self.sums[self.starts + self.sizes] - self.sums[self.starts]
        ahead = self.sums[:-1] - self.sums[self.starts][self.row]
        behind = whole[self.row] - (self.sums[1:] - self.sums[self.starts][self.row])
        new = np.concatenate([[True], (self.codes[1:] != self.codes[:-1]) | (self.row[1:] != self.row[:-1])])
        return np.concatenate([self.row[new], np.arange(len(self.sizes))]), np.concatenate([(ahead + behind * _INVERSE)[new], whole])


def signatures(words: list[str]) -> np.ndarray:
    """64-bit signatures of each word, one row per word.

    Words of one length share one at a multiset distance of two or less and an equal half, words whose
    lengths differ by one at a distance of one; the greater of the two lengths is part of a signature.
    """
    letters, keys = Letters(words), []
    for longer, parts, differ in ((0, 4, 2), (0, 2, 1), (1, 2, 1)):
        size, sums = letters.sizes + longer, letters.part_sums(parts)
        kind = _mix((size * 8 + parts).astype(np.uint64) * _BASE)
        half = size // 2
        halves = letters.piece(np.zeros_like(half), half), ~letters.piece(letters.sizes - (size - half), letters.sizes)
        for taken in combinations(range(parts), parts - differ):
            enumerated = kind + np.uint64(sum(1 << p for p in taken))
            for p in taken:
                enumerated = _mix(enumerated * _BASE ^ sums[p])
            keys += [_mix(enumerated * _BASE ^ _mix(side)) for side in halves]
    return np.stack(keys, axis=1).view(np.int64)


def _keyed(words: DataFrame, per_word, name: str) -> DataFrame:
    """Rows of `words` (word, n and maybe key) with a column `name`, once for each number `per_word` gives of a word."""
    carried, columns = words.columns, [*words.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows, keys = per_word(batch.column("word").to_pylist())
                taken = [batch.column(c).take(pa.array(rows)) for c in carried]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(keys)], columns)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema.fields)
    return words.mapInArrow(run, f"{kinds}, {name} long")


def _by_signature(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    keys = signatures(words)
    return np.repeat(np.arange(len(words)), keys.shape[1]), keys.ravel()


def _by_deletion(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    rows, keys = Letters(words).deletions()
    return rows, keys.view(np.int64)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced letter lies between two words."""
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + 1 :] == b[at + 1 :] and a != b if len(a) == len(b) else a[at:] == b[at + 1 :]


def _long_pairs(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = map(one_edit, batch.column("a").to_pylist(), batch.column("b").to_pylist())
            yield batch.filter(pa.array(met, pa.bool_()))

    return pairs.mapInArrow(run, "a string, n_a long, b string, n_b long")


def _joined(rows: DataFrame, keys: list[str], verify: Column) -> DataFrame:
    left = rows.select(F.col("word").alias("a"), F.col("n").alias("n_a"), *keys)
    right = rows.select(F.col("word").alias("b"), F.col("n").alias("n_b"), *[F.col(k).alias(f"_{k}") for k in keys])
    on = (F.col("a") < F.col("b")) & verify
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return left.join(right, on).select("a", "n_a", "b", "n_b")


def _verified(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of rows that share all of `keys` and are one edit apart."""
    size = F.char_length("word")
    short = _joined(rows.filter(size <= LONG), keys, F.levenshtein("a", "b", 1) == 1)
    long = _joined(rows.filter(size >= LONG), keys, F.greatest(F.char_length("a"), F.char_length("b")) > LONG)
    return short.union(_long_pairs(long))


def near_words(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """a, n_a, b, n_b: each pair of words (word, n; words distinct) exactly one edit apart, once."""
    keyed = stored(_keyed(words, _by_signature, "key"), "spelling-signatures", "zstd")
    sizes = stored(keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "spelling-shared")
    shared = stored(keyed.join(sizes.hint("merge"), "key"), "spelling-candidates", "zstd")
    few = shared.filter(F.col("size") <= bucket).select("word", "n", "key")
    many = _keyed(shared.filter(F.col("size") > bucket).select("word", "n", "key"), _by_deletion, "deletion")
    found = stored(_verified(few, ["key"]).union(_verified(many, ["key", "deletion"])).distinct(), "spelling-pairs", "zstd")
    for done in (keyed, sizes, shared):
        discard(done)
    return found


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every word of `forms` (word, form; no cycles): forms followed to the last, doubling each round."""
    ways, seen = stored(forms.select("word", F.col("form").alias("root")), "spelling-ways"), None
    while True:
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        ways = stored(ways.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-ways")
        if ways.filter("_moved").isEmpty():
            return ways.select("word", "root")
        ways = ways.drop("_moved")


def spelling_groups(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of the corpus.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF of whole texts, A-Z as a-z; where EVERY divides the crc32
    of `<doc_id>:<run>`, the run's letter at that hash modulo its length is left out. Words count from
    LEAST_LENGTH letters and LEAST_COUNT occurrences on. Near words are exactly one inserted, deleted or
    replaced letter apart. `form` is the near word with the largest n (ties: the first in code-point order)
    if that is FACTOR times the word's n or more, else null; `root` ends the chain of forms.

    Null, empty and letterless texts have no words. A null doc_id counts as the empty text in front of the
    colon; rows that repeat an id or a whole row count again. A run may be as long as its text. Extra
    columns are not read; no rows give no rows.
    """
    words = stored(word_counts(docs), "spelling-words", "zstd")
    pairs = near_words(words, bucket)
    both = pairs.select(F.col("a").alias("word"), F.col("n_b").alias("m"), F.col("b").alias("other")).union(pairs.select("b", "n_a", "a"))
    first = F.min(F.struct((-F.col("m")).alias("m"), "other"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), first.alias("best"))
    rows = words.join(best, "word", "left").withColumn("_formed", -F.col("best.m") >= FACTOR * F.col("n"))
    formed = F.when(F.col("_formed"), F.col("best.other")), F.when(F.col("_formed"), -F.col("best.m"))
    rows = stored(rows.select("word", formed[0].alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), formed[1].alias("form_n")), "spelling-forms", "zstd")
    ends = roots(rows.filter("form IS NOT NULL").select("word", "form"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
