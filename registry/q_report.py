"""Report tables and sinks over whole tables."""

from pyspark.sql import functions as F

from registry.base import query
from registry.q_filters import KEYWORDS, _FULL, score_sql
from registry.q_match import SCORED, scored
from registry.sql import PART_LISTINGS, with_tables
from registry.tables import part_listings, profiles
from vacancia.operators import filters as fl
from vacancia.operators import match, report, sinks
from vacancia.session import scratch_path
from vacancia.sources import landing

PART = with_tables(PART_LISTINGS)
_CHANNEL = "CASE priority WHEN 1 THEN 'ats' WHEN 2 THEN 'api' WHEN 3 THEN 'rss' END"


@query("g1_scan_stats", PART + """
SELECT source, count(DISTINCT company) AS companies, count(*) AS found, count(*) FILTER (remote AND seniority IN ('senior', 'mid')) AS kept FROM listings GROUP BY source""")
def g1(spark, sf):
    df = part_listings(spark, sf)
    return report.scan_stats(df, fl.filter_and_score(df, fl.SearchConfig(seniority=["senior", "mid"], remote_only=True)))


@query("g2_verification_counts", PART + "SELECT verification_status, count(*) AS listings FROM listings GROUP BY ALL")
def g2(spark, sf):
    return report.verification_counts(part_listings(spark, sf))


@query("g3_sources_scanned", PART + "SELECT source, count(*) AS listings, count(DISTINCT company) AS companies FROM listings GROUP BY source")
def g3(spark, sf):
    return report.sources_scanned(part_listings(spark, sf))


@query("g4_salary_ranges", PART + """
SELECT salary_currency, seniority, count(*) AS listings, min(salary_min) AS lowest, max(coalesce(salary_max, salary_min)) AS highest, quantile_disc(salary_min, 0.5) AS median_min
FROM listings WHERE salary_min IS NOT NULL AND salary_currency IS NOT NULL GROUP BY ALL""")
def g4(spark, sf):
    return report.salary_ranges(part_listings(spark, sf))


@query("g5_keyword_demand", PART + "SELECT k AS keyword, count(*) AS listings FROM (SELECT unnest(string_split(matched, '|')) AS k FROM ("
       + score_sql(KEYWORDS, "pos", _FULL) + ") WHERE matched <> '') GROUP BY k")
def g5(spark, sf):
    return report.keyword_demand(fl.score_keywords(part_listings(spark, sf), KEYWORDS))


@query("g6_skill_gaps", SCORED + """
SELECT profile_id, skill, demand, ['High','Med','Low'][ntile(3) OVER (PARTITION BY profile_id ORDER BY demand DESC, skill)] AS importance FROM (
  SELECT profile_id, skill, count(*) AS demand FROM (SELECT profile_id, unnest(required) AS skill, skills FROM tiered WHERE tier IS NOT NULL)
  WHERE NOT list_contains(skills, skill) GROUP BY ALL)""")
def g6(spark, sf):
    return report.skill_gaps(match.missing_skills(scored(spark, sf).filter("tier IS NOT NULL"), profiles(spark, sf)))


@query("g7_tier_counts", SCORED + "SELECT profile_id, tier, count(*) AS listings, max(match_score) AS best_score FROM tiered WHERE tier IS NOT NULL GROUP BY ALL")
def g7(spark, sf):
    return report.tier_counts(scored(spark, sf))


@query("g8_source_coverage", PART + "SELECT source, count(*) AS listings, avg(CASE WHEN salary_min IS NOT NULL THEN 1.0 ELSE 0.0 END) AS salary_share FROM listings GROUP BY source")
def g8(spark, sf):
    return report.source_coverage(part_listings(spark, sf))


@query("g9_channel_totals", PART + f"SELECT channel, source, count(*) AS listings FROM (SELECT *, {_CHANNEL} AS channel FROM listings) GROUP BY ROLLUP (channel, source)")
def g9(spark, sf):
    return report.channel_totals(part_listings(spark, sf))


@query("k1_write_results", PART + f"SELECT pos, id, source, {_CHANNEL} AS channel, salary_min FROM listings")
def k1(spark, sf):
    path = scratch_path(spark, "results")
    sinks.write_results(part_listings(spark, sf), path)
    return spark.read.parquet(path).select("pos", "id", "source", "channel", "salary_min")


@query("k2_write_json", PART + """
SELECT id, posted_date::VARCHAR AS posted_date, salary_min, salary_min IS NULL AS null_written, array_to_string(tags, '|') AS tags FROM listings""")
def k2(spark, sf):
    path = scratch_path(spark, "json")
    sinks.write_json(part_listings(spark, sf), path)
    lines = spark.read.text(path)
    obj = F.from_json("value", "id string, posted_date string, salary_min double, tags array<string>")
    return lines.select(obj.alias("o"), F.contains("value", F.lit('"salary_min":null')).alias("null_written")).select(
        "o.id", "o.posted_date", "o.salary_min", "null_written", F.array_join("o.tags", "|").alias("tags"))


@query("k3_write_report", PART + """
SELECT 'sources' AS section, source AS item, count(*) AS listings FROM listings GROUP BY source
UNION ALL SELECT 'verification', verification_status, count(*) FROM listings GROUP BY verification_status""")
def k3(spark, sf):
    path = scratch_path(spark, "report")
    df = part_listings(spark, sf)
    sinks.write_report({"sources": report.sources_scanned(df), "verification": report.verification_counts(df)}, path)
    a = spark.read.parquet(f"{path}/sources").select(F.lit("sources").alias("section"), F.col("source").alias("item"), "listings")
    b = spark.read.parquet(f"{path}/verification").select(F.lit("verification").alias("section"), F.col("verification_status").alias("item"), "listings")
    return a.unionByName(b)


_RELOAD = "id, source, title, salary_min, posted_date::VARCHAR AS posted_date, array_to_string(departments, '|') AS departments"


@query("s18_reread_listings", PART + f"SELECT 'json' AS kind, {_RELOAD} FROM listings UNION ALL SELECT 'parquet', {_RELOAD} FROM listings")
def s18(spark, sf):
    out = None
    for kind in ("json", "parquet"):
        path = scratch_path(spark, kind)
        df = part_listings(spark, sf)
        sinks.write_json(df, path) if kind == "json" else sinks.write_results(df, path)
        part = landing.scan_listings(spark, path, kind).select(
            F.lit(kind).alias("kind"), "id", "source", "title", "salary_min", F.col("posted_date").cast("string").alias("posted_date"),
            F.array_join("departments", "|").alias("departments"))
        out = part if out is None else out.unionByName(part)
    return out
