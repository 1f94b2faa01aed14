"""Session settings and the shared scratch tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the expressions rely on; every one can be changed at run time.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
SPLITS_PER_TASK = 32  # of a scan of small files with very many splits


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "vacancia") -> SparkSession:
    """Session for tests and the bench; a cluster job brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def spread(df: DataFrame) -> DataFrame:
    """Deal a table out to all cores when it has fewer splits than the cluster has cores.

    A large table is already split more finely and passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def packed(scan: DataFrame) -> DataFrame:
    """Give a task of a scan of many small files more of them.

    Spark counts a file as a few megabytes at least (`openCostInBytes`), so a landing zone would be read with a task
    for every handful of documents. A scan of few splits keeps them all; files are streamed, none is held for longer.
    """
    splits, enough = scan.rdd.getNumPartitions(), 16 * scan.sparkSession.sparkContext.defaultParallelism
    return scan if splits <= enough else scan.coalesce(max(enough, splits // SPLITS_PER_TASK))


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for cut-lineage tables: the cluster's `spark.checkpoint.dir`.

    Only a local-mode session without that setting gets a temporary folder of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    own = tempfile.mkdtemp(prefix="vacancia-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/vacancia/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """Write `df` to the shared folder and read it back; `folders` are columns that become partition folders.

    The result survives lost executors, has no lineage, and carries file sizes, so Spark's own
    size-checked broadcast rule applies to it in later joins.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
