"""Streams worked off to their end over whole tables."""

from pyspark.sql import functions as F

from registry import payloads as pl
from registry.base import query
from registry.q_mappings import SQL, flat
from registry.tables import load
from vacancia.functions.text import make_id
from vacancia.session import scratch_path
from vacancia.streaming import incremental as inc


def _finish(spark, df, name):
    path = scratch_path(spark, name)
    inc.run_available(df, path, path + "-progress")
    return spark.read.schema(df.schema).parquet(path)


def _event_stream(spark, sf, per_id=1):
    schema = load(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return events.select(
        make_id("rss", F.floor(F.col("event_id") / per_id)).alias("id"), F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("seen_at"))


@query("x1_stream_landing", SQL["remotive"])
def x1(spark, sf):
    path = pl.land(spark, pl.documents(spark, sf, "remotive"), "remotive")
    return flat(_finish(spark, inc.stream_listings(spark, path, "remotive", "*.txt"), "stream-listings"))


@query("x2_suppress_reposts", "SELECT DISTINCT substring(md5('rss:' || event_id // 3), 1, 12) AS id FROM events")
def x2(spark, sf):
    """Every id is posted three times in a row."""
    path = scratch_path(spark, "reposts")
    return inc.suppress_reposts(_event_stream(spark, sf, per_id=3), path, path + "-progress").select("id")


@query("x3_new_per_day", """
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS source, count(*) AS listings FROM events
GROUP BY ALL""")
def x3(spark, sf):
    """Every day of the table, the last ones too."""
    path = scratch_path(spark, "per-day")
    return inc.new_per_day(_event_stream(spark, sf), path, path + "-progress").withColumn("day", F.col("day").cast("string"))
