"""Similarity self-join that finds every pair with matching-block ratio >= t without comparing all pairs.

Each string is keyed by its rarest grams (short strings by characters too); two strings that match share
at least one of those keys (see `functions.similarity`). Pairs come from an equi-join on the keys, are
thinned by tests no true pair fails (sizes and summaries, then common letters), and only then reach the Arrow ratio. A pair is emitted once, at
the first key both strings share. Keys held by many strings are spread over a grid of cells, so no task
gets a whole hot key.
"""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.functions.similarity import (
    char_mask,
    char_prefix_size,
    fuzzy_match,
    gram_prefix_size,
    near_in_letters,
    near_in_size,
    near_pairs,
    occurrence_keys,
    short_length,
    sorted_chars,
    sorted_grams,
)
from vacancia.session import materialize

# Workers receive the functions themselves, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELL_ROWS = 2000  # strings of one key and side per join cell
GRID_ROWS = 2000, 8192  # fewest and most names on a side of a cell where all pairs are looked at
SMALL_BLOCK = 128  # rows of a side up to which a block is paired without signatures


def signatures(strings: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """Add `sig`, hashed rarest-first keys of every string, `mask`, its character summary, and `len`.

    A string has as many keys as characters, so the per-string group below is bounded by its length.
    """
    n, text = F.length(text_col), F.col(text_col)
    short = n <= short_length(threshold)
    none = F.array().cast("array<int>")
    lists = strings.select("*", sorted_grams(text).alias("_g"), sorted_chars(text).alias("_c"))
    keyed = materialize(
        lists.select("*", occurrence_keys(F.col("_g"), "g").alias("_gk"), occurrence_keys(F.col("_c"), "c").alias("_ck"))
        .select("*", char_mask(F.col("_ck")).alias("mask"), n.alias("len")).drop("_g", "_c"),
        "keys",
    )

    def kind(keys: Column, number: int) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(number).alias("kind"), k.alias("key")))

    both = F.concat(kind(F.col("_gk"), 0), kind(F.when(short, F.col("_ck")).otherwise(none), 1))
    rows = keyed.select(F.col(id_col).alias("_id"), F.inline(both))
    frequency = rows.groupBy("key").agg(F.count("*").alias("n"))
    ordered = (
        rows.join(frequency, "key")
        .groupBy("_id")
        .agg(F.sort_array(F.collect_list(F.struct("n", "key", "kind"))).alias("_keys"))
    )

    def prefix(number: int, size: Column) -> Column:
        return F.slice(F.filter("_keys", lambda k: k["kind"] == number), F.lit(1), size)

    chosen = F.sort_array(F.concat(
        prefix(0, gram_prefix_size(n, threshold)),
        F.when(short, prefix(1, char_prefix_size(n, threshold))).otherwise(F.slice("_keys", 1, 0)),
    ))
    sized = keyed.drop("_gk", "_ck").join(ordered, F.col(id_col) == F.col("_id"))
    return sized.withColumn("sig", F.array_distinct(F.transform(chosen, lambda k: k["key"]))).drop("_keys", "_id")


def _sizes(df: DataFrame, on: list[str], name: str) -> DataFrame:
    return df.groupBy(*on).agg(F.count("*").alias(name))


def _cells(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str) -> tuple[DataFrame, DataFrame]:
    """Add `_row`, `_col`: one cell for ordinary keys, a grid for keys with many rows on a side."""
    hot = (
        _sizes(left, on, "_nl").join(_sizes(right, on, "_nr"), on)
        .filter((F.col("_nl") > CELL_ROWS) | (F.col("_nr") > CELL_ROWS))
        .select(*on, F.ceil(F.col("_nl") / CELL_ROWS).alias("_sl"), F.ceil(F.col("_nr") / CELL_ROWS).alias("_sr"))
    )

    def spread(df, id_col, own, other, own_axis, other_axis):
        with_sizes = df.join(hot, on, "left")
        return (
            with_sizes.withColumn(own_axis, F.pmod(F.xxhash64(id_col), F.coalesce(F.col(own), F.lit(1))))
            .withColumn(other_axis, F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col(other), F.lit(1)) - 1)))
            .drop("_sl", "_sr")
        )

    return spread(left, left_id, "_sl", "_sr", "_row", "_col"), spread(right, right_id, "_sr", "_sl", "_col", "_row")


def candidate_pairs(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str,
                    left_sig: str, right_sig: str, keep: Column) -> DataFrame:
    """Rows of left and right equal on `on` that share a signature key; each pair once.

    Blocks of equal `on` with few rows on either side are paired as they are: their signatures would be more rows than
    their pairs.
    """
    if not on:
        return _keyed_pairs(left, right, on, left_id, right_id, left_sig, right_sig, keep)
    few = _sizes(left, on, "_nl").join(_sizes(right, on, "_nr"), on).filter((F.col("_nl") <= SMALL_BLOCK) & (F.col("_nr") <= SMALL_BLOCK))
    few = materialize(few.select(*on), "small-blocks")
    parts = _pair_tasks(left)
    small = left.drop(left_sig).join(few, on, "left_semi").repartition(parts, *on).join(
        right.drop(right_sig).join(few, on, "left_semi").repartition(parts, *on), on).filter(keep)
    large = [side.join(few, on, "left_anti") for side in (left, right)]
    return small.unionByName(_keyed_pairs(*large, on, left_id, right_id, left_sig, right_sig, keep))


def _pair_tasks(left: DataFrame) -> int:
    """A few rows become many pairs. A fixed partition count keeps the adaptive rules from packing the small inputs into a task or two."""
    spark = left.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def _keyed_pairs(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str, left_sig: str, right_sig: str, keep: Column) -> DataFrame:
    l_keys = left.withColumn("_key", F.explode(left_sig))
    r_keys = right.withColumn("_key", F.explode(right_sig))
    l_cells, r_cells = _cells(l_keys, r_keys, [*on, "_key"], left_id, right_id)
    parts = _pair_tasks(left)
    cell = [*on, "_key", "_row", "_col"]
    pairs = l_cells.repartition(parts, *cell).join(r_cells.repartition(parts, *cell), cell).filter(keep)
    first_shared = F.get(F.array_intersect(left_sig, right_sig), F.lit(0))
    return pairs.filter(first_shared == F.col("_key")).drop("_key", "_row", "_col", left_sig, right_sig)


def _all_near(names: DataFrame, column: str, threshold: float, total: int) -> DataFrame:
    """a, b (a < b) of the pairs of distinct names that sizes, grams and letters leave over, from a grid of all of them.

    A cell has a slice of the names on each side, so a task holds two slices, and takes a few nanoseconds for a pair.
    """
    slices = -(-total // min(max(GRID_ROWS[0], total // 12), GRID_ROWS[1]))
    sliced = names.select(F.col(column).alias("name"), F.pmod(F.xxhash64(column), F.lit(slices)).cast("int").alias("_own"))
    parts = max(_pair_tasks(names), min(slices * (slices + 1) // 2, 2000))

    def dealt(row: Column, col: Column) -> DataFrame:
        return sliced.select("name", row.alias("_row"), col.alias("_col")).repartition(parts, "_row", "_col").groupBy("_row", "_col")

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left["name"].to_pylist(), right["name"].to_pylist()
        found = [(x, y) if x < y else (y, x) for x, y in ((a[i], b[j]) for i, j in zip(*near_pairs(a, b, threshold))) if x != y] if a and b else []
        if left.num_rows and right.num_rows and left["_row"][0] == left["_col"][0]:
            found = list(dict.fromkeys(found))  # a slice with itself has every pair twice
        return pa.table({"a": pa.array([p[0] for p in found], pa.string()), "b": pa.array([p[1] for p in found], pa.string())})

    above = F.explode(F.sequence(F.col("_own"), F.lit(slices - 1)))
    below = F.explode(F.sequence(F.lit(0), F.col("_own")))
    return dealt(F.col("_own"), above).cogroup(dealt(below, F.col("_own"))).applyInArrow(near, "a string, b string")


def similar_names(names: DataFrame, column: str, threshold: float) -> DataFrame:
    """Unordered pairs a < b of distinct names that match in at least one direction.

    `a_later`: ratio(a, b) reaches the threshold (a belongs to the later listing); `b_later` likewise.
    """
    sig = materialize(signatures(names.select(column), column, column, threshold), "name-keys")
    def side(x):
        return sig.select(F.col(column).alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("sig", "mask", "len")])

    a, b, a_len, b_len = F.col("a"), F.col("b"), F.col("a_len"), F.col("b_len")
    keep = (a < b) & near_in_size(a_len, b_len, F.col("a_mask"), F.col("b_mask"), threshold)
    met = _sizes(sig.select(F.explode("sig").alias("key")), ["key"], "n").agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    total = sig.count()
    if met > total * total:  # keys that most names share, as those of digests, would give every pair more than once
        pairs = _all_near(sig.select(column), column, threshold, total)
    else:
        pairs = candidate_pairs(side("a"), side("b"), [], "a", "b", "a_sig", "b_sig", keep)
        pairs = pairs.filter(near_in_letters(a, b, a_len, b_len, threshold))
    return pairs.select(
        "a", "b",
        fuzzy_match(a, b, threshold).alias("a_later"),
        fuzzy_match(b, a, threshold).alias("b_later"),
    ).filter("a_later OR b_later")
