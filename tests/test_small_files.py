"""Landing zones of many small files: tasks and folders do not follow the number of documents, names lead back to them."""

from pyspark.sql import functions as F

from registry import openings as op
from registry import payloads as pl
from vacancia.session import SPLITS_PER_TASK, packed
from vacancia.sources import landing


def _docs(spark):
    texts = ["a\nb", "same", "same", "", None, "c\n"]
    return spark.createDataFrame([(i, f"o{i}", t) for i, t in enumerate(texts)] + [(6, "o6", "same")], "doc long, company string, raw string")


def test_files_lie_in_one_folder_and_lead_to_their_document(spark):
    path, named = op.land_named(spark, _docs(spark), "some")
    read = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    rows = {r["doc"]: (r["company"], r["value"]) for r in named.join(read, "file").collect()}
    assert read.columns == ["file", "value"]  # no partition folder
    assert rows == {d: (c, (t or "") + "\n") for d, c, t in _docs(spark).collect()}
    assert named.select("file").distinct().count() == 7


def test_a_task_takes_many_files(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        n = 16 * spark.sparkContext.defaultParallelism + 40
        path = pl.land_files(spark, spark.range(n).select(F.col("id").alias("doc"), F.lit("x").alias("raw")), "many")
        scan = spark.read.text(path, wholetext=True)
        assert scan.rdd.getNumPartitions() == n
        assert packed(scan).rdd.getNumPartitions() == max(n - 40, n // SPLITS_PER_TASK)
        assert packed(scan).count() == n
        assert landing.scan_payloads(spark, path, "*.txt").rdd.getNumPartitions() < n
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_manifest_is_scanned_once(spark):
    schema = ("mode string, fetched_at string, ats_files array<struct<path:string,source:string,slug:string,company:string>>, "
              "api_files array<struct<path:string,source:string,params:string>>, rss_files array<struct<path:string,source:string,feed_url:string>>")
    docs = spark.createDataFrame([("m", "f", [("p", "s", "l", "c"), None], None, []), ("n", "f", None, [("q", "t", "v")], [("r", "u", "w")])], schema)
    entries = landing.manifest_entries(docs)
    assert sorted(map(str, (tuple(r) for r in entries.collect()))) == sorted(map(str, [
        ("ats", "p", "s", "l", "c", None, None, "m", "f"), ("ats", None, None, None, None, None, None, "m", "f"),
        ("api", "q", "t", None, None, "v", None, "n", "f"), ("rss", "r", "u", None, None, None, "w", "n", "f")]))
    assert "Union" not in entries._jdf.queryExecution().optimizedPlan().toString()
