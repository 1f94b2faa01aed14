"""Near duplicates by 64-bit SimHash, found through one-wildcard variants of fingerprint halves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.llm.common import stored
from vacancia.llm.components import components

SHINGLE, SEED, DISTANCE = 3, 42, 3
BUCKET = 256  # a variant that more fingerprints share is split by variants of the other half
_SLICE = 1 << 16  # shingles of one document whose bits are counted at once


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the shingles' XXH64; 0 for no words. A-Z count as a-z, blanks as one blank."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    stops = ends[len(words) - n :].tolist()
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _SLICE):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _SLICE], stops[at : at + _SLICE], strict=True)]
        counts += np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text.as_py() or "", shingle) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, fp long")


def _variants(part: Column, bits: int, base: int) -> Column:
    """For each bit of a part: (which bit of which part, the part with that bit cleared) as one number."""
    return F.array(*[F.lit((base + i) << bits).cast("long") + part.bitwiseAND(F.lit((1 << bits) - 1 - (1 << i))) for i in range(bits)])


def _cut(fp: Column, bits: int, low: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1))


def _met_at(diff: Column, place: Column) -> Column:
    """Whether a pair's only difference in a part is the wildcard; equal parts meet at wildcard 0 alone."""
    return F.when(diff == 0, place == 0).otherwise((F.bit_count(diff) == 1) & (F.getbit(diff, place.cast("int")) == 1))


def similar(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """a, b: all pairs of distinct fingerprints (column fp) that differ in DISTANCE bits or fewer.

    Of two halves of 32 bits, one differs in one bit at most, so the pair shares a variant of that half with
    one bit a wildcard. Fingerprints that share a variant are joined and compared. A variant shared by more
    than `bucket` fingerprints is joined on a second variant, of a quarter of the other half-pair: with three
    differing bits at most, one of its two 16-bit quarters again differs in one bit at most. That is exact,
    and what then shares both variants differs in 18 given bits only.
    """
    keys = F.concat(_variants(_cut(F.col("fp"), 32, 32), 32, 0), _variants(_cut(F.col("fp"), 32, 0), 32, 32))
    rows = fps.select("fp", F.explode(keys).alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    # A merge join whatever the size of `shared`: it grows with the corpus, and one plan holds at every size.
    rows = stored(rows.join(stored(sizes, "simhash-shared").hint("merge"), "key"), "simhash-candidates")
    few, many = rows.filter(F.col("n") <= bucket), rows.filter(F.col("n") > bucket)
    other = F.when(F.shiftright("key", 37) == 0, F.col("fp")).otherwise(F.shiftrightunsigned("fp", 32))
    quarters = F.concat(_variants(_cut(other, 16, 16), 16, 0), _variants(_cut(other, 16, 0), 16, 16))
    split = many.select("fp", "key", F.explode(quarters).alias("sub"))
    return _pairs(few, ["key"]).union(_pairs(split, ["key", "sub"])).distinct()


def _pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    left = rows.select(F.col("fp").alias("a"), *keys)
    right = rows.select(F.col("fp").alias("b"), *[F.col(k).alias(f"_{k}") for k in keys])
    diff = F.col("a").bitwiseXOR(F.col("b"))
    half = F.when(F.shiftright("key", 37) == 0, _cut(diff, 32, 32)).otherwise(_cut(diff, 32, 0))
    met = _met_at(half, F.shiftright("key", 32) % 32)
    if "sub" in keys:
        rest = F.when(F.shiftright("key", 37) == 0, _cut(diff, 32, 0)).otherwise(_cut(diff, 32, 32))
        quarter = F.when(F.shiftright("sub", 20) == 0, _cut(rest, 16, 16)).otherwise(_cut(rest, 16, 0))
        met = met & _met_at(quarter, F.shiftright("sub", 16) % 16)
    on = (F.col("a") < F.col("b")) & (F.bit_count(diff) <= DISTANCE) & met
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return left.join(right, on).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per input row.

    Documents link when their fingerprints differ in DISTANCE bits or fewer; component_id is the smallest
    doc_id reachable. Equal fingerprints are one node, so copies are never paired with each other.

    Null and blank texts have fingerprint 0 and link like any other. Null doc_ids are linked too but never
    name a component that has another id; repeated ids are rows of their own. Extra columns are not read; no
    rows give no rows.
    """
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    roots = components(similar(nodes.select("fp"), bucket))
    member = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    member = stored(member, "fingerprint-roots")
    names = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(member.join(names, "root").select("fp", "component_id"), "fingerprint-components")
    found = rows.join(named, "fp", "left")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
