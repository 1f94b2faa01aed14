"""Result sets on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vacancia.functions.infer import channel


def write_results(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Listings as Parquet, one folder per channel and source.

    Rows are rebalanced by folder first: the number of files follows the size of each folder, not the number
    of tasks, and a source with most rows is split over several tasks.
    """
    out = df.withColumn("channel", channel("source")).hint("rebalance", "channel", "source")
    out.write.mode(mode).partitionBy("channel", "source").option("maxRecordsPerFile", 5_000_000).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line; nulls are written, dates come out as text."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_report(sections: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Each report section as its own Parquet table under `path`."""
    for name, section in sections.items():
        section.write.mode(mode).parquet(f"{path}/{name}")


COMMITTED = "_sections"


def commit_report(spark: SparkSession, sections: list[str], path: str, mode: str = "errorifexists") -> None:
    """List the sections of a report after the last one was written; a report without the list is unfinished."""
    spark.createDataFrame([(s,) for s in sections], "section string").coalesce(1).write.mode(mode).parquet(f"{path}/{COMMITTED}")


def read_report(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The sections of a committed report; Spark's own error for one that was not committed."""
    listed = spark.read.parquet(f"{path}/{COMMITTED}").collect()  # one row per section
    return {r["section"]: spark.read.parquet(f"{path}/{r['section']}") for r in listed}
