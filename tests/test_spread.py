"""Small tables that are read as one split are dealt out before listings are made of them; ranks sort narrow rows."""

import os

from registry import q_match
from registry.tables import part_listings
from vacancia.session import scratch_root

SF = "/root/testdata/sf0.001"


def test_part_listings_are_made_on_all_cores(spark):
    assert part_listings(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_rank_sorts_keys_alone(spark):
    def tables():
        return {d for d in os.listdir(at) if d.startswith("sorted-")} if os.path.isdir(at) else set()

    at = scratch_root(spark).removeprefix("file:") + "/vacancia"
    before = tables()
    q_match.r9(spark, SF).count()
    (new,) = tables() - before
    columns = spark.read.parquet(f"{at}/{new}").columns
    assert {"profile_id", "tier", "match_score", "pos"} <= set(columns) and "description_text" not in columns


def test_pairs_order_keys_alone(spark):
    from registry import q_dedup

    columns = q_dedup.ordered_keys(spark, SF).columns
    assert {"ord", "ck", "tk"} <= set(columns) and "description_text" not in columns
