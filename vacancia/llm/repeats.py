"""Passages that occur more than once, located with Aho-Corasick automata over words and cut out.

A window is WINDOW consecutive words. Its anchor is its phrase of PHRASE words with the least hash, so equal
windows have equal anchors, at the same place in the window. Windows whose anchor occurs nowhere else are
out. Around each other anchor, windows are compared word by word; those that stand at two places or more
make up the recurring passages, a table of texts with one row for each. The anchor also names the shard in
which the automaton of its passages is compiled from that table, and through which all text around the
anchor streams: what the automaton meets is what is removed.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancia.llm.common import discard, stored
from vacancia.llm.wordhash import gram_hashes, word_hashes

WINDOW, PHRASE = 35, 8
SHARD = 2000  # stretches of text in a shard, and in an automaton, about; an anchor with more is dealt to several
VOCABULARY = 400_000  # words a task remembers before it starts afresh
OUTPUT = 4 << 20  # characters of text in an Arrow batch, about

_STRETCH = "doc_id long, row long, start int, n int, anchor long"
_TEXTS = _STRETCH + ", copies long, words string"
_PASSAGES = "anchor long, copies long, words string"


class Words(dict):
    """Number of each word, and the words' hashes by number."""

    def __init__(self):
        self.hashes = np.empty(1 << 16, np.uint64)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        if number == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.empty_like(self.hashes)])
        self.hashes[number] = xxhash.xxh64_intdigest(word)
        return number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def hashed(self, words: list[bytes]) -> np.ndarray:
        numbers = self.numbers(words)  # may replace `hashes`
        return self.hashes[numbers]


@lru_cache(maxsize=1)
def _vocabulary() -> list[Words]:
    return [Words()]


def vocabulary() -> Words:
    """This worker's words; numbers hold until the next call."""
    held = _vocabulary()
    if len(held[0]) > VOCABULARY:
        held[0] = Words()
    return held[0]


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the first least value of every run of `width` values: runs of 1, 2, 4... and then two that overlap."""
    at, step = np.arange(len(values)), 1
    while step < width:
        ahead = min(step, width - step)
        right = values[ahead:] < values[:-ahead]
        at, values = np.where(right, at[ahead:], at[:-ahead]), np.where(right, values[ahead:], values[:-ahead])
        step += ahead
    return at


def stretches(hashes: np.ndarray, window: int = WINDOW, phrase: int = PHRASE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor of each run of windows with the same anchor place."""
    phrases = gram_hashes(hashes, phrase)
    n, per = len(hashes) - window + 1, window - phrase + 1
    least = leftmost_least(phrases, per)
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return starts, np.diff(np.append(starts, n)), phrases[least[starts]].view(np.int64)


def _documents(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("row", F.xxhash64("text"))


def anchored(rows: DataFrame, window: int, phrase: int) -> DataFrame:
    """_STRETCH rows of every document long enough for a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, found = [], []
            for i, text in enumerate(batch.column("text")):
                hashes = word_hashes(text.as_py().encode())
                if len(hashes) >= window:
                    index.append(i)
                    found.append(stretches(hashes, window, phrase))
            if found:
                starts, counts, anchors = (np.concatenate(x) for x in zip(*found, strict=True))
                at = pa.array(np.repeat(index, [len(x[0]) for x in found]))
                same = [batch.column(c).take(at) for c in ("doc_id", "row")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(starts, pa.int32()), pa.array(counts, pa.int32()), pa.array(anchors)], ["doc_id", "row", "start", "n", "anchor"])

    return rows.select("doc_id", "row", "text").mapInArrow(run, _STRETCH)


def lists(column: pa.Array, fields: tuple[str, ...]) -> tuple[list[tuple[int, int]], list[list]]:
    """First and behind the last entry of each list of structs in a column (null: none), and the fields of all entries."""
    sizes = column.value_lengths().fill_null(0).to_numpy()
    behind, entries = np.cumsum(sizes), column.flatten()
    return list(zip((behind - sizes).tolist(), behind.tolist(), strict=True)), [entries.field(f).to_pylist() for f in fields]


def with_words(rows: DataFrame, hits: DataFrame, window: int) -> DataFrame:
    """_TEXTS rows: the words of the windows of every stretch in `hits` (doc, copies of its anchor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "row", "start", "n", "anchor", "copies", "words"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            found, size = [], 0
            parts, (starts, counts, anchors, copies) = lists(batch.column("hits"), ("start", "n", "anchor", "copies"))
            docs = zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("text"), parts, strict=True)
            for doc_id, row, text, (a, b) in docs:
                words = text.as_py().encode().split()
                for start, n, anchor, many in zip(starts[a:b], counts[a:b], anchors[a:b], copies[a:b], strict=True):
                    stretch = b" ".join(words[start : start + n + window - 1])
                    found.append((doc_id, row, start, n, anchor, many, stretch))
                    size += len(stretch)
                    if size > OUTPUT:
                        yield batch_of(found)
                        found, size = [], 0
            if found:
                yield batch_of(found)

    by_doc = hits.groupBy("doc").agg(F.collect_set(F.struct("start", "n", "anchor", "copies")).alias("hits"))
    keyed = rows.select(F.struct("doc_id", "row").alias("doc"), "text")
    return keyed.join(by_doc, "doc").select("doc.doc_id", "doc.row", "text", "hits").mapInArrow(run, _TEXTS)


def windows_of(texts: list[list[bytes]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of several texts at once: numbers of all words, and text, place and hash of every window."""
    known, sizes = vocabulary(), np.array([len(t) for t in texts])
    numbers = known.numbers([w for t in texts for w in t])
    counts = sizes - window + 1
    at = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return numbers, np.repeat(np.arange(len(texts)), counts), at, gram_hashes(known.hashes[numbers], window)[at]


def same_windows(numbers: np.ndarray, at: np.ndarray, groups: np.ndarray, hashes: np.ndarray, window: int) -> np.ndarray:
    """For each window a class such that windows of one group have the same one if and only if all their words are equal.

    Windows sort by group and hash; each is then compared word by word with the first of its run. Where a
    run holds different words (two hashes collided), its windows are told apart by the words themselves.
    """
    order = np.lexsort((hashes, groups))
    new = np.concatenate([[True], (groups[order][1:] != groups[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])])
    run = np.cumsum(new) - 1
    mine, first = at[order], at[order][new][run]
    equal = np.ones(len(at), bool)
    for k in range(window):
        equal &= numbers[mine + k] == numbers[first + k]
    if not equal.all():
        kinds: dict[tuple, int] = {}
        for i in np.flatnonzero(np.isin(run, run[~equal])).tolist():
            key = (int(run[i]), numbers[mine[i] : mine[i] + window].tobytes())
            run[i] = kinds.setdefault(key, len(order) + len(kinds))
    out = np.empty(len(at), np.int64)
    out[order] = run
    return out


def passages_of(rows: list[tuple], window: int) -> Iterator[tuple]:
    """(anchor, copies, words) of the recurring passages in all (anchor, copies, words) rows of some anchors, each once.

    A passage is a run of neighbouring windows of one text that each stand at two places or more. Equal texts
    are taken apart once and count as often as they occur.
    """
    copies = Counter(rows)
    rows = list(copies)
    texts = [row[2].split() for row in rows]
    numbers, text, at, hashes = windows_of(texts, window)
    groups = np.unique([row[0] for row in rows], return_inverse=True)[1][text]
    kind = np.unique(same_windows(numbers, at, groups, hashes, window), return_inverse=True)[1]
    times = np.fromiter(copies.values(), np.int64, len(copies))
    recurs = np.flatnonzero(np.bincount(kind, times[text])[kind] > 1)
    if not len(recurs):
        return
    cuts = np.flatnonzero((np.diff(recurs) > 1) | (np.diff(text[recurs]) > 0))
    firsts, lasts = recurs[np.concatenate([[0], cuts + 1])], recurs[np.concatenate([cuts, [len(recurs) - 1]])]
    begin, seen = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])), set()
    for i, j in zip(firsts.tolist(), lasts.tolist(), strict=True):
        own, at_first = text[i], begin[np.searchsorted(begin, i, "right") - 1]
        passage = (rows[own][0], rows[own][1], b" ".join(texts[own][i - at_first : j - at_first + window]))
        if passage not in seen:
            seen.add(passage)
            yield passage


def recurring(texts: DataFrame, window: int, shard: int) -> DataFrame:
    """_PASSAGES rows: the passages that recur, confirmed by their words, one row for each text.

    All texts around an anchor are compared in one task, many anchors to a task. An anchor with more than
    `shard` texts has its windows counted one by one, by anchor and words, and each that recurs is a passage.
    """
    shards = max(1, -(-texts.count() // shard))

    def of_batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["anchor", "copies", "words"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for anchor, copies, words in zip(batch.column("anchor").to_pylist(), batch.column("copies").to_pylist(), batch.column("words"), strict=True):
                if len(held) >= shard and anchor != last:
                    if found := list(passages_of(held, window)):
                        yield of_batch(found)
                    held = []
                held.append((anchor, copies, words.as_buffer().to_pybytes()))
                last = anchor
        if held and (found := list(passages_of(held, window))):
            yield of_batch(found)

    def singly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, copies, text in zip(batch.column("anchor").to_pylist(), batch.column("copies").to_pylist(), batch.column("words"), strict=True):
                words = text.as_py().encode().split()
                for at in range(0, len(words) - window + 1, shard):
                    yield of_batch([(anchor, copies, b" ".join(words[i : i + window])) for i in range(at, min(at + shard, len(words) - window + 1))])

    columns = texts.select("anchor", "copies", "words")
    few = columns.filter(F.col("copies") <= shard).withColumn("group", F.pmod("anchor", F.lit(shards)))
    few = few.repartition("group").sortWithinPartitions("anchor").select("anchor", "copies", "words").mapInArrow(together, _PASSAGES)
    # Copies of a text count once, with their number: a crowd of equal texts is one row before it is taken apart.
    many = columns.filter(F.col("copies") > shard).groupBy("anchor", "copies", "words").agg(F.count("*").alias("n"))
    apart = many.filter("n = 1").select("anchor", "copies", "words").mapInArrow(singly, _PASSAGES).withColumn("n", F.lit(1).cast("long"))
    twice = many.filter("n > 1").select("anchor", "copies", "words")
    apart = apart.union(twice.mapInArrow(singly, _PASSAGES).withColumn("n", F.lit(2).cast("long")))
    counted = apart.groupBy("anchor", "copies", "words").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor", "copies", "words")
    return stored(few.union(counted), "repeat-passages", "zstd")


def letters(numbers: np.ndarray) -> str:
    """One character for each number, none of them a surrogate."""
    codes = numbers + 1
    return (codes + 0x800 * (codes >= 0xD800)).astype("<u4").tobytes().decode("utf-32-le")


class Locator:
    """Automaton of passages, a word being a letter; words that no passage has are all the same letter."""

    def __init__(self, passages: list[bytes]):
        self.words: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for passage in passages:
            number = self.words.setdefault
            self.automaton.add_word(letters(np.array([number(w, len(self.words) + 1) for w in passage.split()])))
        self.automaton.make_automaton()

    def located(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word and word behind the last of what passages cover, from the automaton alone.

        All texts run through it in a row, with a letter between them that no passage has.
        """
        words = [t.split() for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(sizes + 1) - sizes - 1
        line = np.zeros(int(sizes.sum()) + len(words), np.int64)
        number = self.words.get
        at = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(words)), sizes)
        line[at] = np.fromiter((number(w, 0) for t in words for w in t), np.int64, len(at))
        met = np.array(list(self.automaton.iter(letters(line))), np.int64).reshape(-1, 2)
        behind, order = met[:, 0] + 1, np.argsort(met[:, 0] + 1 - met[:, 1], kind="stable")
        first, behind = (behind - met[:, 1])[order], np.maximum.accumulate(behind[order])
        new = np.flatnonzero(np.concatenate([[True], first[1:] > behind[:-1]]))[: len(first)]
        first, behind = first[new], behind[np.concatenate([new[1:] - 1, [len(behind) - 1]])] if len(new) else behind
        text = np.searchsorted(begin, first, "right") - 1
        return text, first - begin[text], behind - begin[text]

    def spans(self, words: bytes) -> list[list[int]]:
        """`located` of one text."""
        return [[a, b] for _, a, b in zip(*(x.tolist() for x in self.located([words])), strict=True)]


def occurrences(texts: DataFrame, passages: DataFrame, shard: int) -> DataFrame:
    """doc_id, row, start, stop: words covered by recurring passages. Stretches of a document may overlap.

    Texts and passages of a shard meet in one sorted stream: passages first, which make the automaton, then
    texts, which run through it. An anchor with more than `shard` texts goes to several shards by document,
    each with all of the anchor's passages. Texts around an anchor without passages are not sent.
    """
    shards = max(1, -(-texts.count() // shard))
    group, parts = F.pmod("anchor", F.lit(shards)), F.ceil(F.col("copies") / shard).cast("int")
    place = {"doc_id": "long", "row": "long", "start": "int"}
    columns = ["group", "part", "kind", *place, "words"]
    anchors = stored(passages.select("anchor").distinct(), "repeat-anchored")
    met = texts.join(anchors, "anchor", "left_semi")
    streams = met.withColumns({"group": group, "part": F.pmod(F.xxhash64("doc_id", "row", "start"), parts).cast("int"), "kind": F.lit(1)})
    keys = passages.withColumns({"group": group, "part": F.explode(F.sequence(F.lit(0), parts - 1)), "kind": F.lit(0)} | {c: F.lit(None).cast(t) for c, t in place.items()})
    both = streams.select(*columns).union(keys.select(*columns)).repartition("group", "part").sortWithinPartitions("group", "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, passages, locator = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("group", "part", "kind")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                here, part = tuple(keys[a, :2].tolist()), batch.slice(a, b - a)
                if here != now:
                    now, passages, locator = here, [], None
                words = part.column("words").cast(pa.binary()).to_pylist()
                if keys[a, 2] == 0:
                    passages += words
                    continue
                if locator is None:
                    locator, passages = Locator(passages), []
                text, first, behind = locator.located(words)
                at = part.column("start").to_numpy()[text]
                found = [pa.array((at + x).astype(np.int32)) for x in (first, behind)]
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(text)) for c in ("doc_id", "row")), *found], ["doc_id", "row", "start", "stop"])

    return both.mapInArrow(run, "doc_id long, row long, start int, stop int")


def cut(rows: DataFrame, covered: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words left, one blank between)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            parts, (starts, stops) = lists(batch.column("spans"), ("start", "stop"))
            for doc_id, text, (a, b) in zip(batch.column("doc_id").to_pylist(), batch.column("text"), parts, strict=True):
                words, kept, at = text.as_py().encode().split(), [], 0
                for start, stop in sorted(zip(starts[a:b], stops[a:b], strict=True)):
                    if start > at:
                        kept += words[at:start]
                    at = max(at, stop)
                kept = kept + words[at:] if at else words
                left = b" ".join(kept)
                out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), left.decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    spans = covered.groupBy(F.struct("doc_id", "row").alias("doc")).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    keyed = rows.select(F.struct("doc_id", "row").alias("doc"), "text").join(spans, "doc", "left")
    return keyed.select("doc.doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, shard: int = SHARD) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept: one row per row of `docs`.

    Words are runs of characters other than ASCII blanks, unchanged. Every word inside a window of `window`
    words that also starts elsewhere, in any document or the same one, is removed; windows are judged on
    the input. No copy stays behind.

    Null and blank texts have no words, and a text shorter than a window loses none. Null doc_ids are
    documents like others, and so are rows that repeat an id or a whole row: a repeated row of `window`
    words or more loses all of them. Extra columns are not read; no rows give no rows.
    """
    rows = _documents(docs)
    places = stored(anchored(rows, window, phrase), "repeat-anchors", "zstd")
    shared = stored(places.groupBy("anchor").agg(F.count("*").alias("copies")).filter("copies > 1"), "repeat-shared")
    hits = places.join(shared, "anchor").select(F.struct("doc_id", "row").alias("doc"), "start", "n", "anchor", "copies")
    texts = stored(with_words(rows, hits, window), "repeat-texts", "zstd")
    for done in (places, shared):
        discard(done)
    passages = recurring(texts, window, shard)
    covered = stored(occurrences(texts, passages, shard), "repeat-covered")
    for done in (texts, passages):
        discard(done)
    return cut(rows, covered)
