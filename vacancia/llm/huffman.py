"""Canonical length-limited Huffman codes over token ids: built from counts, packed and read with numpy."""

from __future__ import annotations

import numpy as np

MAX_BITS = 20  # longest code; a decoding table has 2**MAX_BITS entries at most
STEP = 128  # ids between two bit-offset checkpoints


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Bits of each id (0: never occurs) with none above max_bits and the least total: package-merge.

    Each of max_bits rounds pairs what the round before chose and merges the pairs with the single ids; the
    number of rounds whose chosen items hold an id is its length.
    """
    used = np.flatnonzero(counts)
    n = len(used)
    lengths = np.zeros(len(counts), np.uint8)
    if n < 2:
        lengths[used] = 1
        return lengths
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids need codes of more than {max_bits} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    single = counts[used].astype(np.int64)
    rounds, weights = [], np.empty(0, np.int64)
    for _ in range(max_bits):
        packed = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([single, packed])
        order = np.argsort(merged, kind="stable")
        weights = merged[order]
        rounds.append(order < n)  # which places of the merged list are single ids; those keep their order
    take, bits = 2 * n - 2, np.zeros(n, np.uint8)
    for is_single in reversed(rounds):
        singles = int(is_single[:take].sum())
        bits[:singles] += 1
        take = 2 * (take - singles)
    lengths[used] = bits
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code of each id: codes count up in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    code = last = 0
    for i in order[np.count_nonzero(lengths == 0) :]:
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(id, length) for every possible next `width` bits."""
    width = max(1, int(lengths.max(initial=1)))
    order = np.lexsort((np.arange(len(lengths)), lengths))[np.count_nonzero(lengths == 0) :]
    spans = 1 << (width - lengths[order].astype(np.int64))
    ids = np.zeros(1 << width, np.uint32)
    bits = np.ones(1 << width, np.uint8)
    ids[: spans.sum()] = np.repeat(order, spans)
    bits[: spans.sum()] = np.repeat(lengths[order], spans)
    return ids, bits, width


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits of `ids`, highest first, and the bit offset of every STEP-th id."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    total = int(ends[-1]) if len(ends) else 0
    out = np.zeros(total // 32 + 2, np.uint64)
    if len(ids):
        # A code and the up to 31 bits before it fit into two words of 32; no two codes share a bit.
        shifted = codes[ids].astype(np.uint64) << (64 - (starts & 31) - size).astype(np.uint64)
        word = starts >> 5
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] |= np.bitwise_or.reduceat(shifted >> np.uint64(32), first)
        out[word[first] + 1] |= np.bitwise_or.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes()[: (total + 7) // 8], starts[::STEP].astype(np.uint32)


def unpack(data: bytes, count: int, checkpoints: np.ndarray, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """`count` ids; all checkpoints advance together, one table lookup per id."""
    ids, bits, width = table
    raw = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    at = checkpoints.astype(np.int64)
    out = np.empty((STEP, len(at)), np.uint32)
    last = len(window) - 1
    for k in range(STEP):
        here = (window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> np.uint32(32 - width)
        out[k] = ids[here]
        at += bits[here]
    return out.T.reshape(-1)[:count]
