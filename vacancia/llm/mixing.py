"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancia.llm.common import WORD, offsets_by, stored

WEIGHTS = (5, 2, 1)  # for sources by code point, repeating; the null source comes last
PASSES = 3  # a source is read at most so many times
BUCKETS = 4096  # slices of the shuffled order; a source's running sum is taken slice by slice
SEED = "mix"


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from one row per source.

    The level at which sources fill up: a source with the k-th smallest ceiling per weight is full if that
    ceiling is not above what is left for the sources that are not full before it, per weight.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    weighed = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * float(PASSES))
    by_ceiling = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    before = by_ceiling.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    level = left / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    filled = weighed.withColumn("_level", level).withColumn("_full", F.col("_cap") <= F.col("_level") * F.col("_w"))
    rest = F.max(F.when(~F.col("_full"), F.col("_level"))).over(every)  # of the first that is not full
    return filled.withColumn("_rest", rest).select(
        F.col("source").alias("_source"), "source_size", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_rest") * F.col("_w")).alias("target")
    )


def queued(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """`carry`, doc_id, source, size, running words of the source up to each document in shuffled order, target."""
    narrow = docs.select(*carry, "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    narrow = narrow.withColumn("_order", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(SEED))))
    slice_of = F.conv(F.substring("_order", 1, 3), 16, 10).cast("int")
    narrow = stored(narrow.withColumn("_slice", slice_of), "mix-rows")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    ahead = offsets_by(narrow, ["source"], "_slice", "size", "_before")
    # Targets go with the slices: so no join has the source alone, which may hold a third of all rows, as its key.
    ahead = ahead.join(targets(sizes), F.col("source").eqNullSafe(F.col("_source")))
    ahead = ahead.select(F.col("source").alias("_s"), F.col("_slice").alias("_p"), "_before", "source_size", "target")
    so_far = Window.partitionBy("source", "_slice").orderBy("_order", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, 0)
    rows = narrow.withColumn("_within", F.sum("size").over(so_far))
    rows = rows.join(ahead, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_slice") == F.col("_p")))
    return rows.select(*carry, "doc_id", "source", "size", "source_size", "target", "_order", (F.col("_before") + F.col("_within")).alias("_upto"))


def virtual_time(turn) -> Column:
    """When a copy of a document is through: words of its source up to it, over the source's target."""
    return (F.col("source_size") * turn + F.col("_upto")) / F.col("target")


def mix(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of each document the mix takes.

    Every source is a flow of its documents in a fixed shuffled order, read up to PASSES times. A copy's
    virtual finish time is the flow's words so far over the flow's target; all copies are range-sorted by it
    and the first ones whose words sum to no more than the budget (the words of all documents) are taken
    whole. `taken` is therefore a multiple of `size`.

    Null text has size 0 and takes 0. Null sources are one source, sorted last. Rows that repeat a doc_id are
    separate documents; equal ones share their order, so the result is the same in every run. Columns other
    than doc_id, source, text and those of `carry`, which come first in the result, are not read. No rows, or no words at all, take nothing.
    """
    queue = stored(queued(docs, carry), "mix-queue")
    turns = F.explode(F.array(*[F.lit(i) for i in range(PASSES)]))
    copies = queue.filter("size > 0 AND target > 0").select("doc_id", "size", "_order", "target", "source_size", "_upto", turns.alias("_turn"))
    place = ["_time", "_order", "_turn", "doc_id", "size"]
    copies = copies.withColumn("_time", virtual_time(F.col("_turn"))).select(*place)
    ranged = stored(copies.orderBy(*place).withColumn("_part", F.spark_partition_id()), "mix-copies")
    budget = queue.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    # Of the range partitions only the one in which the budget runs out is looked into row by row.
    ahead = offsets_by(ranged, [], "_part", "size", "_before")
    last = ahead.filter(F.col("_before") < budget).orderBy(F.desc("_part")).first()
    taken = F.lit(0).cast("long")
    if last is not None:
        so_far = Window.partitionBy("_part").orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
        edge = ranged.filter(F.col("_part") == last["_part"]).withColumn("_sum", F.sum("size").over(so_far) + last["_before"])
        over = edge.filter(F.col("_sum") > budget).orderBy(*place).first()
        cut = None if over is None else [over[c] for c in place]
        taken = taken_before(cut)
    return queue.select(*carry, "doc_id", "size", "source_size", "target", F.when((F.col("size") > 0) & (F.col("target") > 0), taken).otherwise(0).cast("long").alias("taken"))


def taken_before(cut: list | None) -> Column:
    """Words of the copies of a row that come before the first copy that no longer fits."""
    if cut is None:
        return F.col("size") * PASSES
    total = F.lit(0)
    for turn in range(PASSES):
        here = F.struct(virtual_time(F.lit(turn)).alias("a"), F.col("_order").alias("b"), F.lit(turn).alias("c"), F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), F.col("size").alias("e"))
        edge = F.struct(F.lit(cut[0]).alias("a"), F.lit(cut[1]).alias("b"), F.lit(cut[2]).alias("c"), F.lit(-(2**63) if cut[3] is None else cut[3]).cast("long").alias("d"), F.lit(cut[4]).cast("long").alias("e"))
        total = total + F.when(here < edge, F.col("size")).otherwise(0)
    return total
