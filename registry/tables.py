"""Listings, boards, pages and profiles derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.functions import infer, text
from vacancia.schema import API_SOURCES, ATS_SOURCES, SOURCES, conform
from vacancia.session import spread


LEVELS = ["Director of ", "Head of ", "Senior ", "VP ", "Junior ", "Coordinator ", "", "International "]
SUFFIXES = ["", " Inc", " LLC", " Ltd."]
LOCATIONS = ["Remote", "Hybrid - Berlin", "Remote / office", "NYC", ""]
CURRENCIES = ["USD", "EUR", "AUD"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def listing_url(source: Column, company: Column, key: Column) -> Column:
    slug = F.lower(F.regexp_replace(company, "[^A-Za-z0-9]", ""))
    host = (
        F.when(source == "greenhouse", "https://boards.greenhouse.io/")
        .when(source == "ashby", "https://jobs.ashbyhq.com/")
        .otherwise("https://example.com/")
    )
    return F.concat(host, slug, F.lit("/jobs/"), key.cast("string"))


def status_of(source: Column) -> Column:
    return (
        F.when(source.isin(*ATS_SOURCES), "GUARANTEED")
        .when(source.isin(*API_SOURCES), "API_ACTIVE")
        .otherwise("UNVERIFIED")
    )


def _listing(df: DataFrame, key: Column, brand: Column, posted: Column) -> DataFrame:
    """Listing columns over any frame that carries the part columns."""
    k = F.col("p_partkey")
    base = df.select(
        "*",
        pick(list(SOURCES), k % 10).alias("source"),
        key.cast("string").alias("source_id"),
        F.concat(pick(LEVELS, F.col("p_size") % 8), F.col("p_name")).alias("title"),
        F.concat(brand, pick(SUFFIXES, F.col("p_size") % 4)).alias("company"),
        pick(LOCATIONS, F.col("p_size") % 5).alias("location"),
        F.when(k % 3 != 0, F.col("p_retailprice")).alias("salary_min"),
        posted.alias("posted_date"),
    )
    return base.select(
        "*",
        text.make_id(F.col("source"), F.col("source_id")).alias("id"),
        infer.remote_from_text("location").alias("remote"),
        infer.infer_work_mode("location").alias("work_mode"),
        infer.infer_seniority("title").alias("seniority"),
        F.when(k % 6 == 0, "Full-time").otherwise("").alias("employment_type"),
        F.when(k % 4 != 0, F.col("salary_min") + 500).alias("salary_max"),
        F.when(F.col("salary_min").isNotNull(), pick(CURRENCIES, k % 4)).alias("salary_currency"),
        F.coalesce(F.date_format("posted_date", "yyyy-MM-dd"), F.lit("")).alias("posted_date_raw"),
        F.concat(F.lit("Work on "), F.col("p_type"), F.lit(" line "), F.col("p_name"), F.lit(" for "), brand)
        .alias("description_text"),
        listing_url(F.col("source"), F.col("company"), F.col("source_id")).alias("url"),
        F.array("p_type").alias("departments"),
        F.split("p_name", " ").alias("tags"),
        status_of(F.col("source")).alias("verification_status"),
    ).withColumn("apply_url", F.col("url"))


def part_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing per part; `pos` is its place in the merged input."""
    part = spread(load(spark, sf_dir, "part"))
    k = F.col("p_partkey")
    posted = F.when(k % 11 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (k % 120).cast("int")))
    return conform(_listing(part, k, F.col("p_brand"), posted).select("*", k.alias("pos"))).drop(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"
    )


def order_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing per order line: lineitem with part, orders and customer."""
    lines = spread(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"))
    joined = (
        lines.join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    )
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return conform(
        _listing(joined, key, F.initcap("c_mktsegment"), F.to_date("l_shipdate")).select(
            "*", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("pos")
        )
    ).drop(*joined.columns)


def document_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing per document, whole text as description; quality decides the source."""
    d = spread(load(spark, sf_dir, "documents")).join(load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    source = F.when(F.col("quality") == 1, "greenhouse").when(F.col("quality") == 0, "remotive").otherwise("rss")
    title = F.array_join(F.slice(F.split("text", r"\s+"), 1, 8), " ")
    return conform(d.select(
        text.make_id(source, F.col("doc_id")).alias("id"),
        source.alias("source"),
        F.col("doc_id").cast("string").alias("source_id"),
        title.alias("title"),
        F.col("source").alias("company"),
        F.lit("").alias("location"),
        F.col("text").alias("description_text"),
        F.array().cast("array<string>").alias("departments"),
        F.array("lang").alias("tags"),
        infer.infer_seniority(title).alias("seniority"),
        F.col("doc_id").alias("pos"),
    ))


def fetched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Liveness input: outcome, final address and an injected notice by page id."""
    k = F.col("page_id")
    code = pick([200, 200, 404, 200, 403, 200, 301, 410, 500, 200, 0, 200, 302], k % 13)
    notice = pick(["", "<p>This POSITION has been Filled</p>", "", "", "<p>Job not found.</p>"], k % 5)
    final = (
        F.when(k % 7 == 0, F.lit("https://x.example.com/us/careers/"))
        .when(k % 7 == 1, F.lit("https://x.example.com/jobs"))
        .when(k % 7 == 2, F.lit("https://x.example.com/positions/"))
        .otherwise(F.col("url"))
    )
    body = F.when(k % 17 == 0, F.lit("")).otherwise(F.concat("html", notice))
    return spread(load(spark, sf_dir, "pages")).select(
        "page_id", "url", code.alias("http_code"), final.alias("final_url"), body.alias("body")
    )


def part_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fetched page for nine tenths of the part listings, keyed by listing address."""
    k = F.col("pos")
    return part_listings(spark, sf_dir).filter(k % 10 != 4).select(
        "url",
        pick([200, 200, 404, 403, 200, 500, 200], k % 7).alias("http_code"),
        F.col("url").alias("final_url"),
        F.when(k % 8 == 3, "this job is closed").otherwise(F.concat(F.lit("open: "), F.col("title"))).alias("body"),
    )


def event_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dated listing per event, payload kept as JSON."""
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("pos"),
        text.make_id("rss", F.col("event_id")).alias("id"),
        F.col("event_type").alias("source"),
        F.when(F.col("event_id") % 9 != 0, F.to_date("ts")).alias("posted_date"),
        F.col("ts").alias("seen_at"),
        F.col("props").alias("payload"),
    )


ADJECTIVES = ["small", "red", "blue", "hot", "old", "large", "new", "cold"]
NOUNS = ["ring", "widget", "bolt", "gear", "gizmo", "plate", "anvil", "rod"]
TARGETS = [["senior", "director"], ["junior", "mid"], ["executive"], ["mid", "senior"], ["director", "executive", "senior"]]
MODES = [["remote"], ["remote", "hybrid"], ["onsite"], ["hybrid"], ["remote", "hybrid", "onsite"]]
SECTORS = ["economy", "small", "standard", "medium", "promo", "large"]


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate per region."""
    r = F.col("r_regionkey")

    def rows(values):
        return F.get(F.array(*[F.array(*[F.lit(x) for x in v]) for v in values]), (r % 5).cast("int"))

    return load(spark, sf_dir, "region").select(
        F.col("r_name").alias("profile_id"),
        F.array(pick(ADJECTIVES, r), pick(NOUNS, r), pick(NOUNS, r + 2)).alias("skills"),
        rows(TARGETS).alias("seniority_targets"),
        F.array(pick(SECTORS, r), pick(SECTORS, r + 1)).alias("sectors"),
        F.array(pick(ADJECTIVES, r), pick(NOUNS, r)).alias("keywords"),
        F.array(pick(NOUNS, r + 3)).alias("exclude_keywords"),
        rows(MODES).alias("work_modes"),
        F.array(F.concat(F.lit("brand#"), (r + 1).cast("string")), pick(ADJECTIVES, r + 3)).alias("value_terms"),
        F.array(pick(SECTORS, r + 2)).alias("dealbreaker_terms"),
    )


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One target company per supplier."""
    k = F.col("s_suppkey")
    return load(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"),
        pick(list(ATS_SOURCES), k % 4).alias("ats"),
        F.lower(F.replace("s_name", F.lit("#"), F.lit(""))).alias("slug"),
        F.array_distinct(F.array(pick(SECTORS, k % 6), pick(SECTORS, F.col("s_nationkey") % 6))).alias("sectors"),
        F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("notes"),
    )


def sector_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sector, kind, keyword: the words of the part names seen under each part type; one type has none."""
    part = load(spark, sf_dir, "part").filter(F.col("p_type") != "PROMO")
    sector = F.lower("p_type")
    words = part.select(sector.alias("sector"), F.explode(F.split("p_name", " ")).alias("keyword"))
    titles = words.select("sector", F.lit("title").alias("kind"), "keyword")
    brands = part.select(sector.alias("sector"), F.lit("description").alias("kind"), F.lower("p_brand").alias("keyword"))
    return titles.unionByName(brands).distinct()
