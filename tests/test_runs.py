"""The whole run: channels that were not run, committed reports, and how often the pool is read."""

import pytest
from pyspark.sql import functions as F

from registry import openings as op
from registry.tables import part_listings, profiles
from vacancia.operators import report, sinks
from vacancia.operators.filters import SearchConfig
from vacancia.plans import matching
from vacancia.schema import LISTING
from vacancia.session import scratch_path

SF = "/root/testdata/sf0.001"


def test_run_without_channels(spark):
    """An empty pool is reported as such; nothing fails."""
    whole = op.land_all(spark, SF)
    none = matching.Landing(None, None, None, whole.pages, whole.companies, whole.sector_keywords)
    path = scratch_path(spark, "report")
    out = matching.run(spark, none, SearchConfig(), profiles(spark, SF), ["ring"], F.lit("2024-04-15").cast("date"), path)
    assert out.scored.count() == 0
    sections = sinks.read_report(spark, path)
    assert set(sections) == {"sources", "verification", "salaries", "demand", "tiers", "gaps", "channels", "coverage", "pool"}
    assert tuple(sections["pool"].first()) == (0, True)
    assert all(df.count() == 0 for name, df in sections.items() if name not in ("pool", "channels"))


def test_unfinished_report_is_not_read(spark, tmp_path):
    df = part_listings(spark, SF)
    sinks.write_report({"sources": report.sources_scanned(df)}, str(tmp_path / "r"))
    with pytest.raises(Exception):
        sinks.read_report(spark, str(tmp_path / "r"))
    sinks.commit_report(spark, ["sources"], str(tmp_path / "r"))
    assert sinks.read_report(spark, str(tmp_path / "r"))["sources"].count() == report.sources_scanned(df).count()


def test_landed_files_have_names_of_their_own(spark):
    path, entries = op.land_named(spark, op.board_documents(spark, SF), "named")
    rows = entries.collect()
    assert len({r["file"] for r in rows}) == len(rows) == spark.read.text(path, wholetext=True).count()


def test_sections_from_facts_are_those_of_the_listings(spark):
    df = part_listings(spark, SF).withColumn("matched_keywords", F.array(F.col("source")))
    facts = report.pool_facts(df)
    for section in (report.sources_scanned, report.verification_counts, report.salary_ranges, report.channel_totals, report.source_coverage):
        assert sorted(map(repr, section(df).collect())) == sorted(map(repr, section(facts).collect()))
    stored = spark.read.schema(df.schema).parquet(_written(df, spark))
    sections = report.pool_sections(stored)
    scans = [name for name, s in sections.items() if "pool-facts" not in s.inputFiles()[0]]
    assert scans == ["demand"]  # the facts were read once before
    empty = report.pool_sections(spark.createDataFrame([], LISTING).withColumn("matched_keywords", F.array().cast("array<string>")))
    assert tuple(empty["pool"].first()) == (0, True) and empty["sources"].count() == 0


def _written(df, spark):
    path = scratch_path(spark, "listings")
    df.write.parquet(path)
    return path


def test_files_do_not_follow_the_tasks(spark, tmp_path):
    df = part_listings(spark, SF)
    sinks.write_results(df.repartition(40), str(tmp_path / "r"))
    files = list((tmp_path / "r").rglob("*.parquet"))
    assert len(files) == df.select("source").distinct().count() == 10
    assert spark.read.parquet(str(tmp_path / "r")).count() == df.count()
