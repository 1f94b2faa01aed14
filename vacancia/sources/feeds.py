"""RSS 2.0 and Atom feeds to eight-field items: every file is read and parsed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.functions.feedxml import PART, take_apart
from vacancia.functions.text import blank_to_null, company_from_title, strip_ws
from vacancia.session import packed

FEED_FILES = "*.xml"
FIELDS = ("title", "link", "pubDate", "description", "category", "company", "author", "location")
_PARSED = f"file string, fetched_at timestamp, blank boolean, kind string, parts array<{PART}>, error string"


def parse(spark: SparkSession, path: str, glob: str = FEED_FILES) -> DataFrame:
    """file, fetched_at, blank, kind, parts, error: a row of kind "file" per feed file, then its items and entries.

    `parts` are the children of an item in document order. A file that breaks off anywhere gives no items and the
    parser's message as `error`. The file listing leaves out files of zero length.
    """
    whole = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("ignoreMissingFiles", "true")
        .text(path, wholetext=True)
    )
    documents = whole.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("fetched_at"),
        (strip_ws("value") == "").alias("blank"), "value",
    )
    return packed(documents).mapInArrow(take_apart, _PARSED)


def rejects_of(parsed: DataFrame) -> DataFrame:
    """file, reason, error of feed files that give no items because they cannot be read as XML."""
    reason = F.when(F.col("blank"), "empty").otherwise("broken XML")
    return parsed.filter("kind = 'file' AND error IS NOT NULL").select("file", reason.alias("reason"), "error")


def rejects(spark: SparkSession, path: str, glob: str = FEED_FILES) -> DataFrame:
    return rejects_of(parse(spark, path, glob))


def _named(*tags: str) -> Column:
    return F.filter("parts", lambda p: p["tag"].isin(*tags))


def _last(*tags: str) -> Column:
    """Text of the last of the elements with one of these names."""
    return strip_ws(F.coalesce(F.try_element_at(_named(*tags), F.lit(-1))["text"], F.lit("")))


def _first(tag: str, field: str = "text") -> Column:
    return F.coalesce(F.get(_named(tag), F.lit(0))[field], F.lit(""))


def _joined_categories() -> Column:
    """Categories with ", " between; blank ones before the first filled one leave no mark."""
    texts = F.transform(_named("category"), lambda p: strip_ws(p["text"]))
    return F.aggregate(texts, F.lit(""), lambda a, x: F.when(a == "", x).otherwise(F.concat(a, F.lit(", "), x)))


def _rss() -> dict[str, Column]:
    """Categories joined; of other repeated elements the last one counts, author and creator being one, region and location too."""
    fields = {c: _last(c) for c in ("title", "link", "pubDate", "description")}
    return fields | {"category": _joined_categories(), "author": _last("author", "creator"), "location": _last("region", "location")}


def _atom(fixed: bool) -> dict[str, Column]:
    """The first element of each name. `published` and `summary` count only with elements inside, else `updated` and
    `content` do; with `fixed` the first of the two that has text."""
    def either(a: str, b: str) -> Column:
        first, second = strip_ws(_first(a)), strip_ws(_first(b))
        if fixed:
            return F.coalesce(blank_to_null(first), second)
        return F.when(F.coalesce(F.get(_named(a), F.lit(0))["nested"], F.lit(False)), first).otherwise(second)

    return {
        "title": strip_ws(_first("title")), "link": _first("link", "href"), "pubDate": either("published", "updated"),
        "description": either("summary", "content"),
        "category": F.coalesce(blank_to_null(_first("category", "term")), strip_ws(_first("category"))),
        "author": strip_ws(_first("author/name")), "location": F.lit(""),
    }


def items_of(parsed: DataFrame, fixed: bool = False) -> DataFrame:
    """file and the eight fields of all items and entries; the company is taken from the headline."""
    rss, atom = _rss(), _atom(fixed)
    fields = [F.when(F.col("kind") == "item", rss[c]).otherwise(atom[c]).alias(c) for c in rss]
    rows = parsed.filter("kind <> 'file'").select("file", *fields)
    return rows.withColumn("company", company_from_title("title")).select("file", *FIELDS)


def scan_feeds(spark: SparkSession, path: str, glob: str = FEED_FILES) -> DataFrame:
    """RSS items and Atom entries of all feed files."""
    return items_of(parse(spark, path, glob))


def scan_rss(spark: SparkSession, path: str, glob: str = FEED_FILES) -> DataFrame:
    return items_of(parse(spark, path, glob).filter("kind = 'item'"))


def scan_atom(spark: SparkSession, path: str, fixed: bool = False, glob: str = FEED_FILES) -> DataFrame:
    return items_of(parse(spark, path, glob).filter("kind = 'entry'"), fixed)


def envelopes_of(parsed: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """file, feed_url, fetched_at, item_count, error per feed file; the address is that of the manifest entry of its name."""
    counted = parsed.groupBy("file").agg(
        F.max("fetched_at").alias("fetched_at"), F.count_if(F.col("kind") != "file").alias("item_count"), F.max("error").alias("error"))
    if manifest is None:
        return counted.select("file", F.lit("").alias("feed_url"), "fetched_at", "item_count", "error")
    urls = manifest.select(F.col("path").alias("_name"), "feed_url")
    named = counted.withColumn("_name", F.element_at(F.split("file", "/"), -1)).join(urls, "_name", "left")
    return named.select("file", F.coalesce("feed_url", F.lit("")).alias("feed_url"), "fetched_at", "item_count", "error")


def envelopes(items: DataFrame, files: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """file, feed_url, fetched_at, item_count per feed file; a file without items counts 0.

    `files` lists every landed feed file with `fetched_at`, its modification time.
    """
    counts = items.groupBy("file").agg(F.count("*").alias("item_count"))
    out = files.join(counts, "file", "left").withColumn("item_count", F.coalesce("item_count", F.lit(0).cast("bigint")))
    if manifest is None:
        return out.withColumn("feed_url", F.lit("")).select("file", "feed_url", "fetched_at", "item_count")
    urls = manifest.select(F.col("path").alias("_name"), "feed_url")
    out = out.withColumn("_name", F.element_at(F.split("file", "/"), -1))
    return out.join(urls, "_name", "left").withColumn("feed_url", F.coalesce("feed_url", F.lit(""))).select("file", "feed_url", "fetched_at", "item_count")


def feed_files(spark: SparkSession, path: str, glob: str = FEED_FILES) -> DataFrame:
    """file, fetched_at of every landed feed file; the file listing leaves out files of zero length."""
    return (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).format("binaryFile").load(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("modificationTime").alias("fetched_at"))
    )


def as_payloads(items: DataFrame) -> DataFrame:
    """Feed items in the form the feed mapping reads: one small document per item."""
    item = F.struct(*[F.col(f) for f in FIELDS])
    doc = F.to_json(F.struct(F.array(item).alias("items")))
    keep = [c for c in items.columns if c not in FIELDS]
    return items.select(*keep, F.lit("rss").alias("source"), F.try_parse_json(doc).alias("v"))
