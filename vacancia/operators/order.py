"""Input order as data: a dense position column computed without a one-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancia.functions.infer import source_priority
from vacancia.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in the low 33 bits


def with_position(df: DataFrame, *order: Column | str, name: str = "ord") -> DataFrame:
    """Add `name` = 0, 1, 2... in the given order, which must be total.

    A range sort numbers rows inside each partition; the partition sizes, one row per partition, turn
    those into global positions. The sorted rows are written first, so the numbering cannot move when
    a task is run again.
    """
    numbered = materialize(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_mid", _ROW_BITS)
    row = F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    numbered = numbered.select("*", part.alias("_part"), row.alias("_row")).drop("_mid")
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        numbered.join(offsets, "_part")
        .withColumn(name, F.col("_offset") + F.col("_row"))
        .drop("_part", "_row", "_offset")
    )


def by_source_priority(df: DataFrame, *position: Column | str) -> DataFrame:
    """Stable order of a merged set: source priority first, then its place in the input."""
    return with_position(df.withColumn("priority", source_priority("source")), "priority", *position)


def by_relevance(df: DataFrame, *position: Column | str) -> DataFrame:
    """Best keyword score first, input order among equals."""
    return df.orderBy(F.desc("preliminary_relevance_score"), *position)


# Spark trims groups to k rows before the shuffle only up to this k (its windowGroupLimitThreshold default).
GROUP_LIMIT = 1000


def rank_within(df: DataFrame, groups: list[str], order: list[Column], name: str, top: int | None = None) -> DataFrame:
    """`name` = 1, 2, 3... inside each group; with `top` only the first rows of each.

    A small `top` is trimmed to that many rows per group in every map task. Otherwise the rank comes from a
    range sort over all groups, so a group may hold most of the rows.
    """
    if top is not None and top <= GROUP_LIMIT:
        w = Window.partitionBy(*groups).orderBy(*order)
        return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= top)
    placed = with_position(df, *groups, *order, name="_place")
    starts = placed.groupBy(*groups).agg(F.min("_place").alias("_start")).select("_start", *[F.col(g).alias(f"_{g}") for g in groups])
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups]  # a null group is a group
    ranked = placed.join(starts, same).withColumn(name, F.col("_place") - F.col("_start") + 1).drop("_place", *starts.columns)
    return ranked if top is None else ranked.filter(F.col(name) <= top)


def top_per_source(df: DataFrame, n: int, *position: Column | str) -> DataFrame:
    """First n rows of every source (the source's own row limit, applied locally)."""
    return rank_within(df, ["source"], list(position), "_rn", n).drop("_rn")
