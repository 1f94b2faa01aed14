"""Landing-zone scans: raw payload files, the fetch manifest and the dimension files.

Payload roots and fields change type from document to document, so payloads are kept as VARIANT and
read by path; nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacancia.functions.text import strip_ws
from vacancia.schema import ADDED, LISTING, conform
from vacancia.session import packed
from vacancia.sources import mappings

PAYLOAD_SUFFIXES = "*.json"


def scan_payloads(spark: SparkSession, path: str, glob: str = PAYLOAD_SUFFIXES) -> DataFrame:
    """file, raw: every landed response, one document per file. Files that vanish are skipped.

    Partition folders such as source=.../ become columns, so a filter on them skips the other folders.
    """
    docs = spark.read.option("ignoreMissingFiles", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    folders = [c for c in docs.columns if c != "value"]
    return packed(docs.select(F.col("_metadata.file_name").alias("file"), *folders, F.col("value").alias("raw")))


def parse_payloads(raw: DataFrame) -> DataFrame:
    """Add `v`, the parsed document; null for an empty or broken one."""
    return raw.withColumn("v", F.try_parse_json("raw"))


def listings_in(payloads: DataFrame, source: str) -> DataFrame:
    """One row `j` per listing of the documents of a source, whatever their root; broken ones give none."""
    return mappings.ITEMS[source](payloads)


def merge_pages(payloads: DataFrame, n_pages: int, keys: list[str]) -> DataFrame:
    """Pages 0..n-1 of one paged search per `keys` up to its last page; pages that are no object are skipped.

    A search stops at the first readable page that says it is the last one (`page_count` - 1 or more).
    """
    ok = payloads.filter(F.try_variant_get("v", "$", "map<string,variant>").isNotNull() & (F.col("page") < n_pages))
    count = F.coalesce(F.try_variant_get("v", "$.page_count", "bigint"), F.lit(0))
    stops = ok.filter(F.col("page") >= count - 1).groupBy(*keys).agg(F.min("page").alias("_stop"))
    return ok.join(stops, keys, "left").filter(F.col("_stop").isNull() | (F.col("page") <= F.col("_stop"))).drop("_stop")


def rejects(parsed: DataFrame, *keep: str) -> DataFrame:
    """file, reason (and the columns to keep) of documents that give no rows. One bad response never stops the rest."""
    blank = strip_ws(F.coalesce("raw", F.lit(""))) == ""
    return parsed.filter(F.col("v").isNull()).select("file", *keep, F.when(blank, "empty").otherwise("broken JSON").alias("reason"))


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """channel, path, source, slug, company, params, feed_url of the three typed file lists."""
    schema = (
        "mode string, fetched_at string, "
        "ats_files array<struct<path:string,source:string,slug:string,company:string>>, "
        "api_files array<struct<path:string,source:string,params:string>>, "
        "rss_files array<struct<path:string,source:string,feed_url:string>>"
    )
    doc = spark.read.schema(schema).option("multiLine", "true").json(path)
    return manifest_entries(packed(doc))


_LISTED = {"ats": ("slug", "company"), "api": ("params",), "rss": ("feed_url",)}  # fields beside path and source


def manifest_entries(doc: DataFrame) -> DataFrame:
    """The entries of the three lists in one pass over the documents."""
    fields = ("path", "source", "slug", "company", "params", "feed_url")

    def entries(name, own):
        def entry(e):
            return F.struct(F.lit(name).alias("channel"), *[(e[f] if f in ("path", "source", *own) else F.lit(None).cast("string")).alias(f) for f in fields])

        return F.coalesce(F.transform(f"{name}_files", entry), F.array())

    every = F.concat(*[entries(name, own) for name, own in _LISTED.items()])
    return doc.select("mode", "fetched_at", F.inline(every)).select("channel", *fields, "mode", "fetched_at")


def join_manifest(payloads: DataFrame, manifest: DataFrame) -> DataFrame:
    """Payloads with source, company and feed address of their manifest entry."""
    entries = manifest.select(F.col("path").alias("file"), "channel", "source", "company", "params", "feed_url")
    return payloads.join(entries, "file")


def _override(spark: SparkSession, path: str, override: str | None) -> str:
    """The user's own file when it exists."""
    if override:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(override)
        fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(target):
            return override
    return path


def scan_companies(spark: SparkSession, path: str, override: str | None = None) -> DataFrame:
    """name, ats, slug, sectors, notes of the target companies."""
    schema = "companies array<struct<name:string,ats:string,slug:string,sectors:array<string>,notes:string>>"
    doc = spark.read.schema(schema).option("multiLine", "true").json(_override(spark, path, override))
    return doc.select(F.inline("companies"))


def scan_sector_keywords(spark: SparkSession, path: str, override: str | None = None) -> DataFrame:
    """sector, kind, keyword; entries whose name starts with "_" are remarks."""
    raw = spark.read.text(_override(spark, path, override), wholetext=True)
    return sector_keyword_rows(raw, "value")


def sector_keyword_rows(raw: DataFrame, column: str) -> DataFrame:
    # A remark is text and a sector an object: split the document first, type each sector after.
    entries = raw.select(F.explode(F.from_json(column, "map<string,string>")).alias("sector", "body"))
    lists = entries.filter(~F.startswith("sector", F.lit("_"))).select(
        "sector",
        F.from_json("body", "title_keywords array<string>, description_keywords array<string>, exclude_keywords array<string>").alias("k"),
    )
    kinds = {"title": "title_keywords", "description": "description_keywords", "exclude": "exclude_keywords"}
    pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(f"k.{field}").alias("words")) for kind, field in kinds.items()])
    return lists.select("sector", F.inline(pairs)).select("sector", "kind", F.explode("words").alias("keyword"))


def scan_listings(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Listings written earlier, in the unified schema."""
    everything = T.StructType(LISTING.fields + ADDED.fields)
    reader = spark.read if fmt == "parquet" else spark.read.schema(everything)
    return conform(reader.format(fmt).load(path))


def scan_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """url, http_code, final_url, body of pages fetched for the liveness check."""
    return spark.read.schema("url string, http_code int, final_url string, body string").format(fmt).load(path)
