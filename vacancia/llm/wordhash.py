"""64-bit hashes of all words of a text at once, with numpy; words are runs of bytes other than ASCII blanks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

PIECE = 1 << 20  # bytes of a text that are hashed at once; a word as long as that is hashed alone
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_LETTER = np.array([xxhash.xxh64_intdigest(bytes([b])) for b in range(256)], np.uint64)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


@lru_cache(maxsize=8)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0, 1, 2... modulo 2**64."""
    up, down = np.ones(size, np.uint64), np.ones(size, np.uint64)
    up[1:], down[1:] = BASE, INVERSE
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _piece(data: bytes) -> np.ndarray:
    """A polynomial modulo 2**64 in the letters of each word, from running sums over the whole piece."""
    letters = np.frombuffer(data, np.uint8)
    word = np.concatenate([[False], ~_BLANK[letters], [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(1 << max(10, len(data).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[letters] * up[: len(data)], dtype=np.uint64, out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def word_hashes(data: bytes) -> np.ndarray:
    """One hash for each of data.split(), in order. Memory is bounded by PIECE, however long the text is."""
    if len(data) < PIECE:
        return _piece(data)
    found, at = [], 0
    while at < len(data):
        part = data[at : at + PIECE]
        if len(part) == PIECE:
            blanks = np.flatnonzero(_BLANK[np.frombuffer(part, np.uint8)])
            if not len(blanks):
                behind = next((i for i in range(at + PIECE, len(data)) if _BLANK[data[i]]), len(data))
                found.append(np.array([xxhash.xxh64_intdigest(data[at:behind])], np.uint64))
                at = behind
                continue
            part = part[: int(blanks[-1]) + 1]
        found.append(_piece(part))
        at += len(part)
    return np.concatenate(found)


def gram_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` words, from running sums of a polynomial modulo 2**64."""
    n = len(hashes)
    up, down = powers(1 << max(10, n.bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:n], dtype=np.uint64)])
    return mixed((sums[width:] - sums[:-width]) * down[: n - width + 1])
