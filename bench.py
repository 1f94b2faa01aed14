"""Headline jobs at one scale; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores. Every job is run
BENCH_RUNS times (default 1) after a small warm-up and the best time counts; results are aggregated in Spark, never collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from registry import tables as tb  # noqa: E402
from registry.payloads import documents  # noqa: E402
from registry.q_match import AS_OF  # noqa: E402
from vacancia.functions.html import strip_html  # noqa: E402
from vacancia.operators import dedup, match, order, report, verify  # noqa: E402
from vacancia.operators import filters as fl  # noqa: E402
from vacancia.session import local_session, materialize  # noqa: E402
from vacancia.sources import landing, mappings  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "1"))


def consume(df) -> None:
    """Work out every row and column without keeping them."""
    df.write.format("noop").mode("overwrite").save()


def jobs(spark):
    skills = tb.ADJECTIVES + tb.NOUNS
    search = fl.SearchConfig(["senior", "widget", "economy"], ["senior", "director", "executive"], ["rod"])

    def scored(listings):
        pairs = match.listing_profile_pairs(match.with_required_skills(listings, skills), tb.profiles(spark, SF_DIR))
        pairs = pairs.withColumn("sector_terms", F.col("sectors")).withColumn("company_sectors", F.transform("departments", lambda d: F.lower(d)))
        return match.match_score(pairs, F.lit(AS_OF).cast("date"))

    def clusters(listings):
        return dedup.assign_clusters(order.by_source_priority(dedup.with_match_keys(listings), "pos"))

    def mapped():
        return mappings.normalize(landing.parse_payloads(documents(spark, SF_DIR, "greenhouse")), "greenhouse")

    return {
        "filter_score_orders": lambda: consume(fl.filter_and_score(tb.order_listings(spark, SF_DIR), search)),
        "filter_score_documents": lambda: consume(fl.score_keywords(tb.document_listings(spark, SF_DIR), ["the", "tion", "senior", "que"])),
        "map_greenhouse": lambda: consume(mapped()),
        "strip_html_exact": lambda: consume(tb.load(spark, SF_DIR, "pages").select(strip_html("html").alias("t"))),
        "strip_html_fast": lambda: consume(tb.load(spark, SF_DIR, "pages").select(strip_html("html", "fast").alias("t"))),
        "check_pages": lambda: consume(verify.check_pages(tb.fetched_pages(spark, SF_DIR))),
        "merge_status": lambda: consume(verify.merge_status(tb.part_listings(spark, SF_DIR), verify.check_pages(tb.part_pages(spark, SF_DIR)))),
        "score_orders_x_profiles": lambda: consume(scored(tb.order_listings(spark, SF_DIR))),
        "rank_orders_top10": lambda: consume(match.rank_in_tier(scored(tb.order_listings(spark, SF_DIR)), top=10, position="pos")),
        "report_salary_ranges": lambda: consume(report.salary_ranges(tb.order_listings(spark, SF_DIR))),
        "dedup_parts": lambda: consume(clusters(tb.part_listings(spark, SF_DIR))),
        "dedup_orders": lambda: consume(clusters(tb.order_listings(spark, SF_DIR))),
        "merge_orders": lambda: consume(dedup.fill_fields(materialize(clusters(tb.order_listings(spark, SF_DIR)), "bench"))),
    }


def main() -> None:
    spark = local_session(CPUS, shuffle_partitions=int(CPUS))
    wanted = sys.argv[1:]
    consume(tb.part_listings(spark, SF_DIR))
    times: dict[str, float] = {}
    for name, job in jobs(spark).items():
        if wanted and name not in wanted:
            continue
        best = None
        for _ in range(RUNS):
            start = time.perf_counter()
            job()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    sf = SF_DIR.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf), "cpus": int(CPUS)}))


if __name__ == "__main__":
    main()
