"""The counted tables behind a report; each is one aggregation with map-side partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancia.functions.infer import channel
from vacancia.operators import verify
from vacancia.session import materialize

IMPORTANCE = ["High", "Med", "Low"]


def _listings(df: DataFrame) -> Column:
    """Listings a row stands for: those counted by `pool_facts`, else one."""
    return F.sum(F.col("_n") if "_n" in df.columns else F.lit(1).cast("bigint"))


def pool_facts(df: DataFrame) -> DataFrame:
    """`_n` listings for each combination of what the counted sections look at.

    One pass over the listings; the sections then read these narrow, already counted rows.
    """
    return df.groupBy("source", "company", "verification_status", "seniority", "salary_currency", "salary_min", "salary_max").agg(F.count("*").alias("_n"))


def pool_sections(df: DataFrame) -> dict[str, DataFrame]:
    """Every section that counts the pool. `df` is read twice: for the stored facts and for the keywords."""
    facts = materialize(pool_facts(df), "pool-facts")
    return {
        "sources": sources_scanned(facts),
        "verification": verification_counts(facts),
        "salaries": salary_ranges(facts),
        "demand": keyword_demand(df),
        "channels": channel_totals(facts),
        "coverage": source_coverage(facts),
        "pool": verify.pool_notice(facts),
    }


def union_channels(*channels: DataFrame | None) -> DataFrame:
    """All channel results one after the other; channels that were not run are left out."""
    present = [c for c in channels if c is not None]
    if not present:
        raise ValueError("no channel was run")
    out = present[0]
    for c in present[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


def scan_stats(found: DataFrame, kept: DataFrame) -> DataFrame:
    """Per source: companies scanned, listings found, listings left after the filter."""
    before = found.groupBy("source").agg(F.countDistinct("company").alias("companies"), F.count("*").alias("found"))
    after = kept.groupBy("source").agg(F.count("*").alias("kept"))
    return before.join(after, "source", "left").withColumn("kept", F.coalesce("kept", F.lit(0).cast("bigint")))


def verification_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("verification_status").agg(_listings(df).alias("listings"))


def sources_scanned(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(_listings(df).alias("listings"), F.countDistinct("company").alias("companies"))


def salary_ranges(df: DataFrame) -> DataFrame:
    """Listed salaries only, never mixed across currencies.

    The median (the lower of two middle ones) is exact at every size: listings are counted by amount first,
    so the running sum goes over distinct amounts.
    """
    listed = df.filter(F.col("salary_min").isNotNull() & F.col("salary_currency").isNotNull())
    group = ["salary_currency", "seniority"]
    amounts = listed.groupBy(*group, "salary_min").agg(_listings(df).alias("n"), F.max(F.coalesce("salary_max", "salary_min")).alias("most"))
    every = Window.partitionBy(*group)
    upto = F.sum("n").over(every.orderBy("salary_min").rowsBetween(Window.unboundedPreceding, 0))
    placed = amounts.withColumn("upto", upto).withColumn("all", F.sum("n").over(every))
    return placed.groupBy(*group).agg(
        F.sum("n").alias("listings"),
        F.min("salary_min").alias("lowest"),
        F.max("most").alias("highest"),
        F.min(F.when(F.col("upto") * 2 >= F.col("all"), F.col("salary_min"))).alias("median_min"),
    )


def keyword_demand(scored: DataFrame) -> DataFrame:
    return scored.select(F.explode("matched_keywords").alias("keyword")).groupBy("keyword").agg(F.count("*").alias("listings"))


def skill_gaps(missing: DataFrame) -> DataFrame:
    """Missing skills per profile with demand; importance by thirds of the demand ranking.

    The window runs over one row per profile and skill, after the count.
    """
    demand = missing.groupBy("profile_id", "skill").agg(F.count("*").alias("demand"))
    third = F.ntile(3).over(Window.partitionBy("profile_id").orderBy(F.desc("demand"), "skill"))
    return demand.withColumn("importance", F.get(F.array(*[F.lit(i) for i in IMPORTANCE]), third - 1))


def tier_counts(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("tier").isNotNull()).groupBy("profile_id", "tier").agg(
        F.count("*").alias("listings"), F.max("match_score").alias("best_score")
    )


def source_coverage(df: DataFrame) -> DataFrame:
    """Listings per source and the share that states a salary."""
    listings = _listings(df)
    stated = F.count_if(F.col("salary_min").isNotNull()) if "_n" not in df.columns else F.sum(F.when(F.col("salary_min").isNotNull(), F.col("_n")).otherwise(0))
    return df.groupBy("source").agg(listings.alias("listings"), (stated / listings).alias("salary_share"))


def channel_totals(df: DataFrame) -> DataFrame:
    """Listings by channel and source with channel totals and the overall total (nulls)."""
    counted = df.groupBy("source").agg(_listings(df).alias("_n"))  # the rollup then expands a row per source
    return counted.select(channel("source").alias("channel"), "source", "_n").rollup("channel", "source").agg(F.sum("_n").alias("listings"))
