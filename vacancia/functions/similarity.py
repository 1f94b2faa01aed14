"""Matching-block similarity 2M/T and the JVM-side signatures that bound it from above.

For ratio(a, b) >= t with T = len(a) + len(b), the M matched characters form a common subsequence, so
D = T - 2M <= (1 - t) T characters are unmatched. Hence, without losing a pair:
  * min(len) / max(len) >= t / (2 - t);
  * the character multisets share at least t T / 2;
  * the longest common subsequence has at least M characters, and Levenshtein distance is <= D;
  * the M matches lie in at most D + 1 runs, so at least 3M - T - 1 two-character grams are shared, at most 3D not.
"""

from __future__ import annotations

import math
import sys
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Workers receive the functions themselves, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _by_pair(later: pd.Series, earlier: pd.Series, judge) -> pd.Series:
    """judge(matcher) for each distinct pair of a batch; the matcher's index of a string is used for all its partners."""
    pairs = pd.DataFrame({"a": later.fillna(""), "b": earlier.fillna("")})
    distinct = pairs.drop_duplicates().sort_values("b")
    matcher, last, verdicts = SequenceMatcher(), None, {}
    for a, b in zip(distinct["a"], distinct["b"]):
        if not a or not b:
            verdicts[a, b] = None
            continue
        if b != last:
            matcher.set_seq2(b)
            last = b
        matcher.set_seq1(a)
        verdicts[a, b] = judge(matcher)
    return pd.Series([verdicts[p] for p in zip(pairs["a"], pairs["b"])])


@F.pandas_udf(T.DoubleType())
def ratio(later: pd.Series, earlier: pd.Series) -> pd.Series:
    """Not symmetric: the first argument is the later listing. A blank string has no similarity, 0."""
    return _by_pair(later, earlier, lambda m: m.ratio()).fillna(0.0).astype("float64")


@F.pandas_udf(T.BooleanType())
def ratio_at_least(later: pd.Series, earlier: pd.Series, threshold: pd.Series) -> pd.Series:
    """ratio >= threshold (one value for the whole column)."""
    if threshold.empty:
        return pd.Series([], dtype="bool")
    t = threshold.iloc[0]
    return _by_pair(later, earlier, lambda m: m.ratio() >= t).eq(True)


def fuzzy_match(later: Column, earlier: Column, threshold: float) -> Column:
    return ratio_at_least(later, earlier, F.lit(float(threshold)))


COMMON_LENGTH = 512  # characters of the longer string up to which common subsequences are counted
_WORDS = 1 << 21  # of the tables of places of a slice of pairs


def _distinct(texts: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Number of each text among the distinct ones, and these."""
    numbers: dict[str, int] = {}
    return np.array([numbers.setdefault(t, len(numbers)) for t in texts]), list(numbers)


def _places(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of texts as rows of a matrix, and their lengths."""
    sizes = np.array([len(t) for t in texts])
    return np.array(texts, dtype=f"U{max(1, sizes.max())}").view(np.uint32).reshape(len(texts), -1), sizes


def common_letters(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair of strings, all pairs in lockstep.

    A bit stands for a character of `a` (Hyyro's bit vectors); a step takes the next character of each `b`.
    """
    (a_row, a_texts), (b_row, b_texts) = _distinct(a), _distinct(b)
    (a_chars, a_sizes), (b_chars, b_sizes) = _places(a_texts), _places(b_texts)
    known = np.unique(a_chars[np.arange(a_chars.shape[1]) < a_sizes[:, None]])
    none, words = len(known), -(-a_chars.shape[1] // 64)
    if len(a_texts) * (none + 1) * words > _WORDS and len(a) > 1:
        half = len(a) // 2
        return np.concatenate((common_letters(a[:half], b[:half]), common_letters(a[half:], b[half:])))
    at = np.minimum(np.searchsorted(known, b_chars), none - 1) if none else np.zeros(b_chars.shape, np.int64)
    same = (known[at] == b_chars) & (np.arange(b_chars.shape[1]) < b_sizes[:, None]) if none else np.zeros(b_chars.shape, bool)
    steps = np.ascontiguousarray(np.where(same, at, none)[b_row].T)
    has = np.zeros((words, len(a_texts), none + 1), np.uint64)  # by word: the places of each character in each text of a
    for i in range(a_chars.shape[1]):
        rows = np.flatnonzero(a_sizes > i)
        has[i // 64, rows, np.searchsorted(known, a_chars[rows, i])] |= np.uint64(1 << (i % 64))
    has, first = has.reshape(words, -1), a_row * (none + 1)
    left = np.full((words, len(a)), np.uint64(2**64 - 1))  # zeros are the characters of a in the subsequence
    for step in steps:
        place, carry = first + step, None
        for w in range(words):
            met, old = has[w][place], left[w]
            met &= old
            total = old + met
            over = total < old
            if carry is not None:
                total += carry
                over |= total < carry
            left[w] = total | (old ^ met)
            carry = over.astype(np.uint64)
    return 64 * words - np.bitwise_count(left).sum(axis=0, dtype=np.int64)


@F.pandas_udf(T.BooleanType())
def _common_at_least(a: pd.Series, b: pd.Series, threshold: pd.Series) -> pd.Series:
    """Whether the longest common subsequence is as long as the matched characters of a ratio >= threshold; null for a missing string."""
    out, (sizes, others) = pd.Series([None] * len(a), dtype="boolean"), (s.str.len().fillna(0).to_numpy() for s in (a, b))
    given = (a.notna() & b.notna()).to_numpy()
    words = -(-sizes // 64)
    for n in np.unique(words[given]):  # strings of a few words are not put with longer ones
        rows = np.flatnonzero(given & (words == n))
        common = common_letters(a.to_numpy()[rows], b.to_numpy()[rows])
        out.iloc[rows] = 2.0 * common >= threshold.iloc[0] * (sizes[rows] + others[rows]) - 1e-9
    return out


GRAM_BITS = 1024  # of a summary of grams
_ROWS = 64  # of one side that meet the whole other side at once


def _gram_bits(texts: list[str]) -> np.ndarray:
    """Summary of the gram multiset of each text in 64-bit words; every differing bit stands for a gram that is not shared."""
    rows = []
    for text in texts:
        bits, seen = 0, {}
        for gram in zip(text, text[1:]):
            n = seen[gram] = seen.get(gram, 0) + 1
            bits |= 1 << (hash((gram, n)) % GRAM_BITS)
        rows.append(bits.to_bytes(GRAM_BITS // 8, "little"))
    return np.frombuffer(b"".join(rows), np.uint64).reshape(len(texts), -1)


def near_pairs(a: list[str], b: list[str], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pairs of a and b that no test rules out: lengths, at most 3D grams not shared, common letters."""
    a_size, b_size = (np.array([len(t) for t in x], np.int64) for x in (a, b))
    a_bits, b_bits = _gram_bits(a), np.ascontiguousarray(_gram_bits(b).T)
    a_kept, b_kept, band = [], [], threshold / (2 - threshold)
    for first in range(0, len(a), _ROWS):
        rows = slice(first, first + _ROWS)
        size = a_size[rows, None]
        differing = np.zeros((len(size), len(b)), np.int16)
        for own, others in zip(a_bits[rows].T, b_bits):
            differing += np.bitwise_count(own[:, None] ^ others)
        near = differing <= 3 * np.floor((size + b_size) * (1 - threshold) + 1e-9)
        near &= np.minimum(size, b_size) >= np.maximum(size, b_size) * band - 1e-9
        i, j = np.nonzero(near)
        a_kept.append(i + first)
        b_kept.append(j)
    i, j = np.concatenate(a_kept), np.concatenate(b_kept)
    judged = np.flatnonzero(np.maximum(a_size[i], b_size[j]) <= COMMON_LENGTH)
    keep, (a_texts, b_texts) = np.ones(len(i), bool), (np.array(x, object) for x in (a, b))
    for part in np.array_split(judged, max(1, len(judged) // 10_000)):
        if len(part):
            least = threshold * (a_size[i[part]] + b_size[j[part]]) - 1e-9
            keep[part] = 2.0 * common_letters(a_texts[i[part]], b_texts[j[part]]) >= least
    return i[keep], j[keep]


def least_matched(total: int, threshold: float) -> int:
    """Smallest M with 2M/T >= threshold."""
    m = max(0, math.floor(threshold * total / 2) - 1)
    while 2.0 * m / total < threshold:
        m += 1
    return m


def grams_shared_at_least(total: int, threshold: float) -> int:
    return 3 * least_matched(total, threshold) - total - 1


def short_length(threshold: float) -> int:
    """Longest string that can be in a pair for which no shared gram is guaranteed."""
    if threshold < 0.7:
        raise ValueError("signatures are only complete for thresholds of 0.7 and more")
    # From 200 characters on (1.5 t - 1) T - 1 >= 1 holds for every such threshold.
    weak = [total for total in range(2, 200) if grams_shared_at_least(total, threshold) < 1]
    possible = [
        max(n, total - n) for total in weak for n in range(1, total) if min(n, total - n) >= least_matched(total, threshold)
    ]
    return max(possible, default=0)


def sorted_grams(text: Column) -> Column:
    """Two-character grams of the text, equal ones side by side; [] for under two characters."""
    pieces = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(F.length(text) >= 2, F.sort_array(pieces)).otherwise(F.array().cast("array<string>"))


def sorted_chars(text: Column) -> Column:
    return F.sort_array(F.split(text, ""))


def occurrence_keys(sorted_items: Column, mark: str) -> Column:
    """One hash per item and occurrence: "x","x","y" -> h(x1), h(x2), h(y1).

    Multiset overlap becomes plain set overlap. `sorted_items` should be a column of its own: the lambda
    reads it once per item.
    """
    return F.transform(sorted_items, lambda x, i: F.hash(F.lit(mark), x, i - F.array_position(sorted_items, x)))


def gram_prefix_size(n: Column, threshold: float) -> Column:
    """How many of a string's rarest grams suffice to meet every partner in at least one of them."""
    band = threshold / (2 - threshold)
    need = F.ceil((1.5 * threshold - 1) * (n + F.ceil(n * band - 1e-9)) - 1 - 1e-9)
    return F.greatest(F.lit(0), (n - 1) - F.greatest(F.lit(1), need) + 1).cast("int")


def char_prefix_size(n: Column, threshold: float) -> Column:
    band = threshold / (2 - threshold)
    return (n - F.ceil(n * band - 1e-9) + 1).cast("int")


def char_mask(char_keys: Column) -> Column:
    """64-bit summary of the character multiset; every differing bit stands for an unmatched character."""
    def bit(key):
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(key, F.lit(64)))

    return F.aggregate(char_keys, F.lit(0).cast("bigint"), lambda acc, key: acc.bitwiseOR(bit(key)))


def _unmatched_allowed(a_len: Column, b_len: Column, threshold: float) -> Column:
    return F.floor((a_len + b_len) * (1 - threshold) + 1e-9).cast("int")


def near_in_size(a_len: Column, b_len: Column, a_mask: Column, b_mask: Column, threshold: float) -> Column:
    """Cheapest test no true pair fails: length band and, where both have one, character summary."""
    band = threshold / (2 - threshold)
    in_band = F.least(a_len, b_len) >= F.greatest(a_len, b_len) * band - 1e-9
    return in_band & F.coalesce(F.bit_count(a_mask.bitwiseXOR(b_mask)) <= _unmatched_allowed(a_len, b_len, threshold), F.lit(True))


def near_in_edits(a: Column, b: Column, a_len: Column, b_len: Column, threshold: float) -> Column:
    """Levenshtein distance within the unmatched characters allowed; no true pair fails it.

    With its bound given, Spark's function stops early and answers -1 beyond it.
    """
    return F.call_function("levenshtein", a, b, _unmatched_allowed(a_len, b_len, threshold)) >= 0


def near_in_letters(a: Column, b: Column, a_len: Column, b_len: Column, threshold: float) -> Column:
    """The longest common subsequence has the characters that a match needs; no true pair fails it.

    Closer than the edits for strings that share few characters in order, such as digests. Long strings are judged by edits.
    """
    short = F.greatest(a_len, b_len) <= COMMON_LENGTH
    common = _common_at_least(F.when(short, a), F.when(short, b), F.lit(float(threshold)))
    return F.when(short, common).otherwise(near_in_edits(a, b, a_len, b_len, threshold))
