"""Which terms are substrings of which texts: Aho-Corasick automata as numpy tables, many places of a text in lockstep.

Texts and terms are compared as UTF-8 bytes, in which a whole character never begins inside another one, so
terms are found where their characters are. Time follows the letters of the texts and the terms found,
not the number of terms; texts of any length are cut into lanes that overlap by the longest term.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Workers receive the functions themselves, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHARD = 1 << 16  # bytes of the terms of one automaton, whose table has a row for each at most
BLOCK = 1 << 19  # bytes of text taken at once
MARKS = 1 << 23  # of (text, term) in a block
LANE = 128  # steps of a block, besides the overlap


class Automaton:
    """Finds distinct terms (bytes, none empty). A state is the longest end of what was read that begins a term."""

    def __init__(self, terms: list[bytes]):
        self.lengths = np.array([len(t) for t in terms])
        letters, starts = np.frombuffer(b"".join(terms), np.uint8), np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.kind = np.zeros(256, np.int32)  # 0: a byte of no term, and the end of a text
        used = np.unique(letters)
        self.kind[used] = np.arange(1, len(used) + 1)
        self.shift = int(len(used)).bit_length()
        # The trie, level by level: parents and byte of every state.
        at, n, levels = np.zeros(len(terms), np.int64), 1, []
        for depth in range(self.lengths.max()):
            longer = np.flatnonzero(self.lengths > depth)
            edges, which = np.unique((at[longer] << self.shift) + self.kind[letters[starts[longer] + depth]], return_inverse=True)
            at[longer] = n + which
            levels.append((np.arange(n, n + len(edges)), edges >> self.shift, edges & ((1 << self.shift) - 1)))
            n += len(edges)
        table, back = np.zeros((n, 1 << self.shift), np.int32), np.zeros(n, np.int64)
        ends = np.zeros(n, np.int32)
        ends[at] = np.arange(1, len(terms) + 1)
        self.shorter = np.zeros(len(terms) + 1, np.int32)  # of a term: the longest other one that it ends with
        for depth, (states, parents, kinds) in enumerate(levels):
            if depth:
                back[states] = table[back[parents], kinds]
                # A parent's row begins as that of its shorter end; the parents' own children come next.
            table[parents, kinds] = states
            table[states] = table[back[states]]
            own = ends[states]
            self.shorter[own[own > 0]] = ends[back[states[own > 0]]]
            ends[states] = np.where(own > 0, own, ends[back[states]])
        self.next, self.ends = (table << self.shift).ravel(), ends

    def find(self, letters: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and term (from 0) of every term found, in order; `letters` are those of all texts, `lengths` their bytes."""
        rows = np.repeat(np.arange(len(lengths)), lengths + 1)  # a text is followed by one place that ends it
        kinds = np.zeros(len(rows), np.int32)
        kinds[np.arange(len(letters)) + np.repeat(np.arange(len(lengths)), lengths)] = self.kind[letters]
        before = int(self.lengths.max()) - 1  # steps after which a lane knows its state
        lane = max(LANE, 4 * before)
        lanes = -(-len(kinds) // lane)
        padded = np.concatenate((np.zeros(before, np.int32), kinds, np.zeros(lanes * lane - len(kinds), np.int32)))
        steps = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (before + lane, lanes), (padded.itemsize, lane * padded.itemsize)))
        state, place, read = np.zeros(lanes, np.int32), np.empty(lanes, np.int64), np.empty((lane, lanes), np.int32)
        for i, step in enumerate(steps):
            np.add(state, step, out=place)
            state = np.take(self.next, place, out=read[max(i - before, 0)], mode="clip")
        hits = self.ends[read >> self.shift].T.ravel()[: len(kinds)]
        some, width = np.flatnonzero(hits), len(self.shorter)
        marked = np.zeros(len(lengths) * width, bool)
        marked[rows[some] * width + hits[some]] = True
        new = np.flatnonzero(marked)
        while len(new):  # a term found brings those that it ends with
            ended = self.shorter[new % width]
            new = (new - new % width + ended)[ended > 0]
            new = np.unique(new[~marked[new]])
            marked[new] = True
        text, term = np.divmod(np.flatnonzero(marked), width)
        return text, term - 1


def automata(terms: list[bytes]) -> Iterator[tuple[Automaton, pa.Array]]:
    """Automata of at most SHARD bytes of terms (or a single term), each with its terms."""
    part, size = [], 0
    for term in [*sorted(set(terms) - {b""}), None]:
        if part and (term is None or size + len(term) > SHARD):
            yield Automaton(part), pa.array(part, pa.binary()).view(pa.string())
            part, size = [], 0
        if term is not None:
            part.append(term)
            size += len(term)


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of texts without nulls, and where each begins."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def _blocks(at: np.ndarray, width: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most BLOCK bytes, or one longer text, and of at most MARKS marks."""
    first, n = 0, len(at) - 1
    while first < n:
        last = int(np.searchsorted(at, at[first] + BLOCK, "right")) - 1
        last = min(max(last, first + 1), first + max(1, MARKS // width), n)
        yield first, last
        first = last


def finder(terms: list[bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (key, text) without null texts: (key, term) for each term in a text, once a row."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = list(automata(terms))
        for batch in batches:
            if not batch.num_rows:
                continue
            data, at = _letters(batch.column(1))
            for automaton, names in made:
                for first, last in _blocks(at, len(names) + 1):
                    text, term = automaton.find(data[at[first] : at[last]], np.diff(at[first : last + 1]))
                    if len(text):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text + first)), names.take(pa.array(term))], [batch.schema.names[0], "term"])

    return find
