"""Incremental landing: the same scans and mappings on a file stream.

Fuzzy clustering depends on order and stays a batch job; these streams feed the table it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vacancia.sources import landing, mappings


def stream_payloads(spark: SparkSession, path: str, glob: str = landing.PAYLOAD_SUFFIXES, files_per_trigger: int = 10_000) -> DataFrame:
    """file, seen_at, v of newly landed documents, one per file."""
    docs = (
        spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(files_per_trigger)).load(path)
    )
    return landing.parse_payloads(docs.select(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("seen_at"), F.col("value").alias("raw")))


def stream_listings(spark: SparkSession, path: str, source: str, glob: str = landing.PAYLOAD_SUFFIXES) -> DataFrame:
    return mappings.normalize(stream_payloads(spark, path, glob), source)


def suppress_reposts(listings: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """First sighting of every id, kept in the table at `path`, whose rows are the state.

    A batch is reduced to its first sightings and joined to the table, so no row is too late to be looked
    at. Each batch writes its own folder, so a batch that runs again replaces what it wrote before.
    """
    spark, columns = listings.sparkSession, listings.columns

    def merge(batch: DataFrame, number: int) -> None:
        first = batch.groupBy("id").agg(F.min_by(F.struct(*columns), "seen_at").alias("row")).select("row.*")
        known = _written(spark, path)
        if known is not None:
            first = first.join(known.filter(F.col("batch") < number).select("id"), "id", "left_anti")
        first.select(*columns).write.mode("overwrite").parquet(f"{path}/batch={number}")

    _run_batches(listings, merge, checkpoint)
    return spark.read.schema(listings.schema).parquet(path)


def _written(spark: SparkSession, path: str) -> DataFrame | None:
    """id, batch of the sightings so far; None before the first batch."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.schema("id string, batch int").parquet(path)


def _run_batches(df: DataFrame, merge, checkpoint: str) -> None:
    query = df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def new_per_day(listings: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """day, source, listings so far, of every day, however late its rows come.

    Every batch adds its own counts to the table at `path`; the sum over batches is the answer. There is
    no state to expire and no day that waits to be closed.
    """
    counted = listings.withColumn("day", F.to_date("seen_at"))

    def add(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("day", "source").agg(F.count("*").alias("listings"))
        counts.write.mode("overwrite").parquet(f"{path}/batch={number}")

    _run_batches(counted, add, checkpoint)
    written = listings.sparkSession.read.schema("day date, source string, listings long").parquet(path)
    return written.groupBy("day", "source").agg(F.sum("listings").alias("listings"))


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Work off everything that has landed, then stop; the next run goes on from the checkpoint."""
    query = (
        df.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
