"""What several operators of this package share: reading, lineage cuts, text helpers, running sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacancia.session import scratch_path

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Shuffle files of a finished write are not needed again: its rows are in the written table.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def configured(fn: Callable) -> Callable:
    """A query run with Arrow batches small enough for whole documents (a batch is at most 500 rows)."""

    def run(spark: SparkSession, *rest) -> DataFrame:
        spark.conf.set(ARROW_ROWS, "500")
        return fn(spark, *rest)

    run.__doc__ = fn.__doc__
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write `df` to the shared scratch folder and read it back: lineage is cut, lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by `stored` that nothing will read again."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getParent().getName() != "vacancia":
            raise ValueError(f"{folder} is no scratch table")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is (`lower` alone would change letters beyond ASCII)."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def same(left: str, right: str) -> Column:
    """Equality for joins in which null meets null."""
    return F.col(left).eqNullSafe(F.col(right))


def offsets_by(df: DataFrame, groups: list[str], part: str, amount: str, name: str) -> DataFrame:
    """For each (groups, part): the sum of `amount` over the parts before it. One row for each part at most."""
    sums = df.groupBy(*groups, part).agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*groups, part, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias(name))
