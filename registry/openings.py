"""Openings landed by two boards, two searches and feeds at once, with everything a whole run reads.

A firm has the openings of one key range. Firms and titles carry long digests, so two of them are alike only
where they are the same, and duplicates can be named exactly in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from registry import payloads as pl
from registry.tables import LOCATIONS, SECTORS, load, pick
from vacancia.plans.matching import Landing
from vacancia.session import materialize, packed, scratch_path

BOARDS = ("greenhouse", "remotive", "himalayas")
KEYWORDS, EXCLUDE = ["small", "ring", "hot"], ["rod"]


def openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, doc, p_name, p_type, t (title), co (firm), d (date), place: one opening per part."""
    k = pl.key()
    digest = F.concat(F.md5(k.cast("string")), F.md5((k + 7).cast("string")))
    doc = F.floor(k / pl.DOC_ROWS)
    return load(spark, sf_dir, "part").select(
        k.alias("k"), doc.alias("doc"), "p_name", "p_type", F.concat(pl.title(), F.lit(" "), digest).alias("t"),
        F.concat(F.lit("Firm "), F.md5(doc.cast("string"))).alias("co"),
        F.date_add(F.lit("2024-01-01").cast("date"), (k % 120).cast("int")).alias("d"), pick(LOCATIONS, F.col("p_size") % 5).alias("place"),
        F.concat(F.lit("<p>Work on "), F.col("p_type"), F.lit("</p><ul><li>"), F.col("p_name"), F.lit("</li></ul> &amp; more")).alias("html"),
    )


def _address(host: str) -> Column:
    return F.concat(F.lit(host), F.col("k").cast("string"))


def _items() -> dict[str, tuple[Column, Column]]:
    """For each board: which openings it has, and the JSON of one."""
    k, date = F.col("k"), F.concat(F.date_format("d", "yyyy-MM-dd"), F.lit("T10:00:00Z"))
    named = lambda c: F.struct(F.col(c).alias("name"))
    fields = {
        "greenhouse": (k % 2 == 0, {
            "id": k, "title": F.col("t"), "location": named("place"), "departments": F.array(named("p_type")), "updated_at": date,
            "content": F.col("html"), "absolute_url": _address("https://boards.greenhouse.io/x/")}),
        "remotive": (k % 5 < 2, {
            "id": k, "title": F.concat("t", F.lit(" (Remote)")), "company_name": F.col("co"), "publication_date": date, "description": F.col("html"),
            "url": _address("https://r/"), "category": F.col("p_type"), "tags": F.split("p_name", " ")}),
        "himalayas": ((k % 7 == 0) | (k % 5 == 2), {
            "id": k, "title": F.col("t"), "companyName": F.concat("co", F.lit(" LLC")), "seniority": F.when(k % 3 == 0, "Senior Level"), "minSalary": k, "maxSalary": k * 2,
            "pubDate": date, "description": F.col("html"), "applicationUrl": _address("https://h/"), "category": F.col("p_type"), "tags": F.array(F.lit("x"))}),
    }
    return {s: (has, F.to_json(F.struct(*[v.alias(n) for n, v in f.items()]))) for s, (has, f) in fields.items()}


def board_documents(spark: SparkSession, sf_dir: str, sources=BOARDS) -> DataFrame:
    """doc (dense over all sources), source, company, raw: a document per board and firm; some are broken."""
    rows, parts = openings(spark, sf_dir), None
    n_docs = rows.agg(F.max("doc")).first()[0] + 1
    for i, source in enumerate(sources):
        has, item = _items()[source]
        listed = rows.filter(has).select("doc", "co", "k", item.alias("j")).groupBy("doc", "co").agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "j"))), lambda x: x["j"]), ",").alias("body"))
        cut = F.when(F.col("doc") % 9 == 4, F.lit("")).otherwise(F.lit("]}"))  # every ninth document breaks off
        part = listed.select((F.col("doc") + i * n_docs).alias("doc"), F.lit(source).alias("source"), F.concat("co", F.lit(" Inc")).alias("company"),
                             F.concat(F.lit('{"jobs":['), F.col("body"), cut).alias("raw"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def land_named(spark: SparkSession, docs: DataFrame, name: str) -> tuple[str, DataFrame]:
    """Write documents (`doc`, raw, and others) one file each; returns the folder and the others with their `file` name.

    Spark names the files. A document's file is one that holds its text; documents of equal texts have as many files,
    and take them in order.
    """
    docs = materialize(docs, f"{name}-documents")
    path = pl.land_files(spark, docs, name)
    files = packed(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.sha2("value", 256).alias("_text")))
    written = F.concat(F.coalesce("raw", F.lit("")), F.lit("\n"))  # the writer ends a file with a line break

    def counted(df, by):
        return df.withColumn("_n", F.row_number().over(Window.partitionBy("_text").orderBy(by)))

    texts = docs.filter("doc IS NOT NULL").withColumn("_text", F.sha2(written, 256)).drop("raw")
    named = counted(texts, "doc").join(counted(files, "file"), ["_text", "_n"]).drop("_text", "_n")
    return path, materialize(named, f"{name}-files")


def manifest_of(spark: SparkSession, boards: DataFrame) -> str:
    """Manifests of the landed files, as a fetcher leaves them: a hundred documents that share the files."""
    ats = F.collect_list(F.when(F.col("source") == "greenhouse", F.struct(F.col("file").alias("path"), "source", F.lit("slug").alias("slug"), "company")))
    api = F.collect_list(F.when(F.col("source") != "greenhouse", F.struct(F.col("file").alias("path"), "source", F.lit("page=0").alias("params"))))
    lists = boards.groupBy((F.col("doc") % 100).alias("m")).agg(ats.alias("ats_files"), api.alias("api_files"))
    doc = F.to_json(F.struct(F.lit("prefetched").alias("mode"), F.lit("2024-04-15T00:00:00Z").alias("fetched_at"), "ats_files", "api_files", F.expr("array() AS rss_files")))
    return pl.land_files(spark, lists.select(F.col("m").alias("doc"), doc.alias("raw")), "manifests")


def feed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, raw: one RSS file per firm, its openings by k % 3."""
    k = F.col("k")
    item = F.concat(
        F.lit("<item><title>"), F.col("t"), F.lit("</title><link>https://f/"), k.cast("string"), F.lit("</link><pubDate>"), F.date_format("d", "dd MMM yyyy"),
        F.lit(" 10:00:00 +0000</pubDate><description>&lt;b&gt;"), F.col("p_type"), F.lit("&lt;/b&gt;</description><category>"), F.col("p_type"),
        F.lit("</category><author>"), F.col("co"), F.lit("</author></item>"))
    rows = openings(spark, sf_dir).filter(k % 3 != 1).select("doc", "k", item.alias("x"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda e: e["x"]), "\n")
    return rows.groupBy("doc").agg(body.alias("body")).select("doc", F.concat(F.lit("<rss><channel>"), F.col("body"), F.lit("</channel></rss>")).alias("raw"))


def fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, http_code, final_url, body: the pages of most openings outside the boards."""
    k, urls = F.col("k"), F.array(*[_address(h) for h in ("https://r/", "https://h/", "https://f/")])
    return openings(spark, sf_dir).filter(k % 10 != 4).select(k, F.explode(urls).alias("url")).select(
        "url", pick([200, 200, 404, 403, 200, 500, 200], k % 7).alias("http_code"), F.col("url").alias("final_url"),
        F.when(k % 8 == 3, "this job is closed").otherwise("open").alias("body"))


def company_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company files; every second firm is known, with one sector."""
    doc = F.col("doc")
    firms = openings(spark, sf_dir).select("doc", "co").distinct().filter(doc % 2 == 0)
    row = F.struct(F.concat("co", F.lit(" Ltd.")).alias("name"), F.lit("greenhouse").alias("ats"), F.lit("s").alias("slug"), F.array(pick(SECTORS, doc % 6)).alias("sectors"), F.lit("").alias("notes"))
    return firms.groupBy(F.floor(doc / pl.DOC_ROWS).alias("doc")).agg(F.to_json(F.struct(F.collect_list(row).alias("companies"))).alias("raw"))


def land_all(spark: SparkSession, sf_dir: str) -> Landing:
    boards, entries = land_named(spark, board_documents(spark, sf_dir), "boards")
    pages = scratch_path(spark, "fetched")
    fetched(spark, sf_dir).write.parquet(pages)
    return Landing(
        boards=boards, manifest=manifest_of(spark, entries), feeds=pl.land_files(spark, feed_documents(spark, sf_dir), "feeds"), pages=pages,
        companies=pl.land_files(spark, company_documents(spark, sf_dir), "firms"), sector_keywords=pl.land(spark, pl.sector_documents(spark, sf_dir), "sectors"), glob="*.txt")
