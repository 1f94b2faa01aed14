"""Scans of landed files. Spark writes the files from the given tables first, one document per file."""

from pyspark.sql import functions as F

from registry import openings as op
from registry import payloads as pl
from registry.base import query
from registry.sql import COMPANIES, SECTOR_KEYWORDS, with_tables
from vacancia.sources import feeds, landing, mappings

_DOCS = "WITH p AS (SELECT *, p_partkey AS k, p_partkey // 50 AS doc, ['Director of ','Senior ','','Junior '][p_partkey % 4 + 1] || p_name AS t, ['Remote','Hybrid - Berlin','Remote / office','NYC',''][p_size % 5 + 1] AS place, strftime(DATE '2024-01-01' + CAST(p_partkey % 120 AS INTEGER), '%Y-%m-%d') AS iso FROM part)\n"
TXT = "*.txt"


def landed(spark, sf, source):
    """Parsed documents of one source as read back from its landing folder."""
    return landing.parse_payloads(landing.scan_payloads(spark, pl.land(spark, pl.documents(spark, sf, source), source), TXT))


@query("s1_scan_payloads", _DOCS + """
SELECT doc, count(*) AS listings, sum(k)::BIGINT AS id_sum, CASE WHEN doc % 3 = 2 THEN 'ARRAY' ELSE 'OBJECT' END AS root FROM p GROUP BY doc""")
def s1(spark, sf):
    docs = landed(spark, sf, "greenhouse")
    items = landing.listings_in(docs, "greenhouse").groupBy("doc").agg(
        F.count("*").alias("listings"), F.sum(F.try_variant_get("j", "$.id", "bigint")).alias("id_sum"))
    root = docs.select("doc", F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0).alias("root"))
    return items.join(root, "doc").select(F.col("doc").cast("bigint").alias("doc"), "listings", "id_sum", "root")


# Where each source keeps its number and its headline.
_FIELDS = {
    "greenhouse": ("$.id", "$.title"), "lever": ("$.id", "$.text"), "workable": ("$.id", "$.title"), "ashby": ("$.id", "$.title"),
    "remotive": ("$.id", "$.title"), "remoteok": ("$.id", "$.position"), "jobicy": ("$.id", "$.companyName"), "himalayas": ("$.slug", "$.title"), "themuse": ("$.id", "$.name"),
}


def _scan(source):
    key, headline = _FIELDS[source]

    def run(spark, sf):
        items = landing.listings_in(landed(spark, sf, source), source)
        return items.select(
            F.col("doc").cast("bigint").alias("doc"), F.regexp_replace(F.try_variant_get("j", key, "string"), "^s-", "").alias("number"),
            F.try_variant_get("j", headline, "string").alias("headline"))

    run.__name__ = f"scan_{source}"
    return run


for _i, _source in enumerate(_FIELDS, start=2):
    query(f"s{_i}_scan_{_source}", _DOCS + f"SELECT doc, k::VARCHAR AS number, {'p_brand' if _source == 'jobicy' else 't'} AS headline FROM p")(_scan(_source))


@query("s11_merge_pages", _DOCS + """
SELECT doc // 8 AS search, count(*) AS total, max(doc % 8) AS last_page FROM p WHERE doc % 8 <= 2 AND doc % 8 <> 1 GROUP BY 1""")
def s11(spark, sf):
    """Searches of eight landed pages each; page 1 of every search failed."""
    docs = landed(spark, sf, "themuse").withColumn("search", F.floor(F.col("doc") / 8)).withColumn("page", F.col("doc") % 8)
    docs = docs.withColumn("v", F.when(F.col("page") != 1, F.col("v")))
    merged = landing.merge_pages(docs, 6, ["search"])
    return landing.listings_in(merged, "themuse").groupBy("search").agg(F.count("*").alias("total"), F.max("page").cast("bigint").alias("last_page"))


@query("s12_scan_rss", _DOCS + """
SELECT t || ' at ' || replace(p_brand, '#', ' & ') AS title, 'https://f/' || k AS link, 'Mon, 06 Jan 2025 10:00:00 +0000' AS "pubDate", '<b>' || p_type || '</b>' AS description,
  p_type || ', B' AS category, replace(p_brand, '#', ' & ') AS company, CASE WHEN k % 2 = 0 THEN 'Ann' ELSE 'Bob' END AS author, CASE WHEN k % 3 = 0 THEN place ELSE '' END AS location
FROM p WHERE doc % 9 <> 4""")
def s12(spark, sf):
    return feeds.scan_rss(spark, pl.land_files(spark, pl.rss_documents(spark, sf), "rss-xml"), TXT).select(*feeds.FIELDS)


@query("s12_last_element", _DOCS + """
SELECT 'https://f/' || k AS link, CASE WHEN k % 2 = 0 THEN 'Ann' ELSE 'Bob' END AS author,
  CASE WHEN k % 3 <> 0 THEN 'Base' WHEN doc % 2 = 0 THEN 'Later' ELSE place END AS location FROM p WHERE doc % 9 <> 4""")
def s12_last(spark, sf):
    """Every item has an author and a creator, most a region and a location, in either order: the last one counts."""
    both = F.replace(F.replace("raw", F.lit("<author>Bob"), F.lit("<dc:creator>Eve</dc:creator><author>Bob")), F.lit("<dc:creator> Ann"), F.lit("<author>Zed</author><dc:creator> Ann"))
    early = F.replace(both, F.lit("<title>"), F.lit("<location>Base</location><title>"))
    docs = pl.rss_documents(spark, sf).withColumn("raw", F.when(F.col("doc") % 2 == 0, F.replace(early, F.lit("</region>"), F.lit("</region><location>Later</location>"))).otherwise(early))
    return feeds.scan_rss(spark, pl.land_files(spark, docs, "rss-both"), TXT).select("link", "author", "location")


_ATOM = """SELECT t AS title, 'https://a/' || k AS link, {date} AS "pubDate", {text} AS description, CASE WHEN k % 4 = 0 THEN p_type ELSE 'plain' END AS category,
  '' AS company, replace(p_brand, '#', ' ') AS author, '' AS location FROM p WHERE doc % 9 <> 4"""


@query("s13_scan_atom", _DOCS + _ATOM.format(date="CASE WHEN k % 2 = 0 THEN iso ELSE '' END", text="CASE WHEN k % 3 = 0 THEN p_type ELSE '' END"))
def s13(spark, sf):
    return feeds.scan_atom(spark, pl.land_files(spark, pl.atom_documents(spark, sf), "atom-xml"), glob=TXT).select(*feeds.FIELDS)


@query("s13_scan_atom_fixed", _DOCS + _ATOM.format(date="iso || 'T10:00:00Z'", text="'sum'"))
def s13_fixed(spark, sf):
    return feeds.scan_atom(spark, pl.land_files(spark, pl.atom_documents(spark, sf), "atom-xml"), fixed=True, glob=TXT).select(*feeds.FIELDS)


@query("s14_feed_envelopes", _DOCS + "SELECT doc, CASE WHEN doc % 9 = 4 THEN 0 ELSE count(*) END AS item_count, '' AS feed_url, true AS dated FROM p GROUP BY doc")
def s14(spark, sf):
    path = pl.land(spark, pl.rss_documents(spark, sf), "rss-xml")
    env = feeds.envelopes(feeds.scan_rss(spark, path, TXT), feeds.feed_files(spark, path, TXT))
    return env.select(F.regexp_extract("file", r"doc=(\d+)", 1).cast("bigint").alias("doc"), "item_count", "feed_url", F.col("fetched_at").isNotNull().alias("dated"))


@query("s14_manifest_envelopes", _DOCS + """
SELECT doc, CASE WHEN doc % 9 = 4 THEN 0 ELSE count(*) END AS item_count, CASE WHEN doc % 5 = 0 THEN '' ELSE 'https://feed/' || doc END AS feed_url,
  CASE WHEN doc % 18 = 4 THEN 'mismatched tag: line ' || count(*) WHEN doc % 18 = 13 THEN 'no element found: line ' || (count(*) + 1) END AS error FROM p GROUP BY doc""")
def s14_manifest(spark, sf):
    """Envelopes with the feed address of the manifest (a fifth has no entry) and the parser's message up to its line."""
    path, entries = op.land_named(spark, pl.rss_documents(spark, sf).select("doc", F.lit("rss").alias("source"), F.lit("").alias("company"), "raw"), "named-feeds")
    manifest = entries.filter("doc % 5 <> 0").select(F.col("file").alias("path"), F.concat(F.lit("https://feed/"), F.col("doc").cast("string")).alias("feed_url"))
    env = feeds.envelopes_of(feeds.parse(spark, path, TXT), manifest).withColumn("file", F.element_at(F.split("file", "/"), -1))
    return env.join(entries.select("file", "doc"), "file", "left").select("doc", "item_count", "feed_url", F.regexp_extract("error", r"^(.*line \d+)", 1).alias("error"))


@query("s15_scan_manifest", _DOCS + """
SELECT CASE src WHEN 'greenhouse' THEN 'ats' WHEN 'workable' THEN 'ats' WHEN 'rss' THEN 'rss' ELSE 'api' END AS channel, src || '-' || doc || '.json' AS path, src AS source,
  CASE WHEN src IN ('greenhouse', 'workable') THEN 'Owner ' || doc % 4 END AS company, CASE WHEN src = 'rss' THEN 'https://feed/' || doc END AS feed_url,
  CASE WHEN src IN ('remotive', 'themuse') THEN 'page=' || doc END AS params
FROM (SELECT DISTINCT doc FROM p), (SELECT unnest(['greenhouse', 'workable', 'remotive', 'themuse', 'rss']) AS src)""")
def s15(spark, sf):
    return landing.scan_manifest(spark, pl.land_files(spark, pl.manifest_documents(spark, sf), "manifest")).select("channel", "path", "source", "company", "feed_url", "params")


@query("j2_manifest_payloads", _DOCS + """
SELECT k::VARCHAR AS source_id, 'greenhouse' AS source, CASE k % 3 WHEN 0 THEN p_brand WHEN 1 THEN 'Board' ELSE 'Owner ' || doc % 4 END AS company FROM p""")
def j2(spark, sf):
    """Landed files find their company through the manifest entry of their name."""
    path, entries = op.land_named(spark, pl.documents(spark, sf, "greenhouse").select("doc", "source", F.col("fallback_company").alias("company"), "raw"), "named")
    manifest = landing.scan_manifest(spark, op.manifest_of(spark, entries))
    docs = landing.parse_payloads(landing.scan_payloads(spark, path, TXT))
    joined = landing.join_manifest(docs, manifest).withColumnRenamed("company", "fallback_company")
    listings = mappings.with_company_fallback(mappings.normalize(joined, "greenhouse"))
    return listings.select("source_id", "source", "company")


@query("s16_scan_companies", with_tables(COMPANIES) + "SELECT name, ats, slug, CASE WHEN s1 = s2 THEN s1 ELSE s1 || '|' || s2 END AS sectors, notes FROM companies")
def s16(spark, sf):
    path = pl.land(spark, pl.company_documents(spark, sf), "companies")
    return landing.scan_companies(spark, path, override=path + "-local").select("name", "ats", "slug", F.array_join("sectors", "|").alias("sectors"), "notes")


@query("s17_scan_sector_keywords", with_tables(SECTOR_KEYWORDS) + """
SELECT sector, kind, keyword FROM sector_keywords UNION ALL SELECT DISTINCT sector, 'exclude', 'intern' FROM sector_keywords""")
def s17(spark, sf):
    return landing.scan_sector_keywords(spark, pl.land(spark, pl.sector_documents(spark, sf), "sectors"))


@query("s20_feed_rejects", _DOCS + "SELECT DISTINCT doc, 'broken XML' AS reason FROM p WHERE doc % 9 = 4")
def s20_feeds(spark, sf):
    bad = feeds.rejects(spark, pl.land(spark, pl.rss_documents(spark, sf), "rss-xml"), TXT)
    return bad.select(F.regexp_extract("file", r"doc=(\d+)", 1).cast("bigint").alias("doc"), "reason")


@query("s20_rejects", _DOCS + """
SELECT doc, 0 AS listings, CASE WHEN doc % 4 = 1 THEN 'broken JSON' ELSE 'empty' END AS reason FROM (SELECT DISTINCT doc FROM p WHERE doc % 4 IN (1, 3))
UNION ALL SELECT doc, count(*), 'read' FROM p WHERE doc % 4 IN (0, 2) GROUP BY doc""")
def s20(spark, sf):
    """A quarter of the documents broken and a quarter empty; the rest is read all the same."""
    docs = pl.documents(spark, sf, "workable")
    spoiled = F.when(F.col("doc") % 4 == 1, F.expr("substring(raw, 1, length(raw) - 1)")).when(F.col("doc") % 4 == 3, " ").otherwise(F.col("raw"))
    path = pl.land(spark, docs.withColumn("raw", spoiled), "spoiled")
    parsed = landing.parse_payloads(landing.scan_payloads(spark, path, TXT)).withColumn("doc", F.col("doc").cast("bigint"))
    bad = landing.rejects(parsed, "doc").select("doc", F.lit(0).cast("bigint").alias("listings"), "reason")
    good = landing.listings_in(parsed, "workable").groupBy("doc").agg(F.count("*").alias("listings")).withColumn("reason", F.lit("read"))
    return bad.unionByName(good)


@query("m10_rss_from_feed", _DOCS + """
SELECT substring(md5('rss:https://f/' || k), 1, 12) AS id, t || ' at ' || replace(p_brand, '#', ' & ') AS title, replace(p_brand, '#', ' & ') AS company, p_type AS description_text,
  'Mon, 06 Ja' AS posted_date_raw, '2025-01-06' AS posted_date, p_type || ', B' AS departments FROM p WHERE doc % 9 <> 4""")
def m10_feed(spark, sf):
    items = feeds.scan_rss(spark, pl.land_files(spark, pl.rss_documents(spark, sf), "rss-xml"), TXT)
    listings = mappings.normalize(feeds.as_payloads(items), "rss")
    return listings.select("id", "title", "company", "description_text", "posted_date_raw", F.col("posted_date").cast("string").alias("posted_date"), F.array_join("departments", "|").alias("departments"))
