"""Search hits to a pool: the way of listings that were compiled by searching, without boards or feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.operators import dedup, verify
from vacancia.operators.filters import drop_stale


def search_pool(hits: DataFrame, checks: DataFrame, as_of: Column, *position: Column | str) -> DataFrame:
    """Of hits for the same opening the most detailed one, none past 90 days, with `age_band` and its status.

    `hits` holds snippets and rows filled in from their pages alike; `position` is their place. A hit on a board is
    GUARANTEED and meets no check; of the others those whose page is closed go, those whose page was read as open are
    VERIFIED and the rest, failed checks included, UNVERIFIED. Hits without company and title are kept as they are.
    """
    fresh = drop_stale(dedup.keep_most_detailed(hits, *position), as_of)
    marked = fresh.withColumn("verification_status", verify.search_status("url", F.lit(False)))
    checked = verify.join_checks(marked, checks).filter(F.coalesce("check_status", F.lit("")) != "EXPIRED")
    read = F.coalesce(F.col("check_status") == "VERIFIED", F.lit(False))
    return checked.withColumn("verification_status", verify.search_status("url", read)).drop("check_status", "check_reason")
