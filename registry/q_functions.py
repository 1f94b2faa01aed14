"""Scalar functions over whole tables."""

from pyspark.sql import functions as F

from registry import fuzzy
from registry.base import query
from registry.sql import DOCUMENT_LISTINGS, FULL_TEXT, PAGES, PART_LISTINGS, PHRASES, company_fold, priority, seniority, with_tables, work_mode
from registry.tables import document_listings, fetched_pages, load, part_listings
from vacancia.functions import infer, similarity, text
from vacancia.functions.html import strip_html
from vacancia.operators import verify

_PLAIN = "SELECT page_id, regexp_replace(regexp_replace(html, '<script[^>]*>(.*?)</script>|<style[^>]*>(.*?)</style>|<!--.*?-->|</?[a-zA-Z!][^>]*>', '\\1\\2', 'gs'), '^\\s+|\\s+$', '', 'g') AS bare FROM pages"
_DECODED = "replace(replace(replace(replace(replace(replace(replace(replace(bare, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&')"


@query("n1_strip_html", f"SELECT page_id, md5({_DECODED}) AS text_md5, length({_DECODED}) AS n_chars FROM ({_PLAIN})")
def n1(spark, sf):
    t = strip_html("html")
    pages = load(spark, sf, "pages").select("page_id", t.alias("t"))
    return pages.select("page_id", F.md5("t").alias("text_md5"), F.length("t").alias("n_chars"))


@query("n2_make_id", with_tables(PART_LISTINGS) + "SELECT pos, id, substring(md5('rss:' || source_id), 1, 12) AS rss_id, substring(md5(source || ':'), 1, 12) AS empty_id FROM listings")
def n2(spark, sf):
    return part_listings(spark, sf).select(
        "pos", "id", text.make_id("rss", F.col("source_id"), F.lit("")).alias("rss_id"), text.make_id(F.col("source"), F.lit("")).alias("empty_id")
    )


@query("n3_infer_seniority", with_tables(PART_LISTINGS, DOCUMENT_LISTINGS) + f"""
SELECT 'part' AS kind, pos, {seniority('title')} AS seniority FROM listings
UNION ALL SELECT 'document', pos, {seniority('description_text')} FROM doc_listings""")
def n3(spark, sf):
    a = part_listings(spark, sf).select(F.lit("part").alias("kind"), "pos", infer.infer_seniority("title").alias("seniority"))
    b = document_listings(spark, sf).select(F.lit("document").alias("kind"), "pos", infer.infer_seniority("description_text").alias("seniority"))
    return a.unionByName(b)


@query("n4_infer_work_mode", with_tables(PART_LISTINGS) + f"SELECT pos, {work_mode('location')} AS work_mode, {work_mode('title')} AS title_mode FROM listings")
def n4(spark, sf):
    return part_listings(spark, sf).select("pos", infer.infer_work_mode("location").alias("work_mode"), infer.infer_work_mode("title").alias("title_mode"))


@query("n5_remote_flag", with_tables(PART_LISTINGS) + """
SELECT pos, contains(lower(location), 'remote') AS by_location, contains(lower(title || location), 'remote') AS by_title,
  contains(lower(location), 'flexible') OR contains(lower(location), 'remote') AS flexible FROM listings""")
def n5(spark, sf):
    return part_listings(spark, sf).select(
        "pos", infer.remote_from_text("location").alias("by_location"), infer.remote_from_text("title", "location").alias("by_title"),
        infer.remote_from_text("location", words=("flexible", "remote")).alias("flexible"),
    )


@query("n6_int_salary", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN nullif(p_partkey, 0) WHEN p_partkey % 3 = 1 THEN NULL ELSE p_partkey END AS salary FROM part""")
def n6(spark, sf):
    k = F.col("p_partkey")
    raw = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat(k.cast("string"), F.lit(".5"))).otherwise(F.concat(F.lit(" "), k.cast("string"), F.lit(" ")))
    return load(spark, sf, "part").select("p_partkey", infer.int_salary(raw).alias("salary"))


@query("n7_default_currency", with_tables(PART_LISTINGS) + "SELECT pos, CASE WHEN salary_min IS NOT NULL OR salary_max IS NOT NULL THEN coalesce(salary_currency, 'USD') END AS currency FROM listings")
def n7(spark, sf):
    present = F.col("salary_min").isNotNull() | F.col("salary_max").isNotNull()
    return part_listings(spark, sf).select("pos", infer.default_currency(present, F.col("salary_currency")).alias("currency"))


@query("n8_date_prefix", """
SELECT event_id, substring(CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%a, %d %b %Y %H:%M:%S +0000') END, 1, 10) AS raw, strftime(ts, '%Y-%m-%d') AS typed FROM events""")
def n8(spark, sf):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    rfc = F.concat(F.date_format("ts", "E"), F.lit(", "), F.date_format("ts", "dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    first = F.when(F.col("event_id") % 2 == 0, iso).otherwise("")
    raw = text.first_filled(first, rfc)
    return load(spark, sf, "events").select("event_id", infer.date_prefix(first, rfc).alias("raw"), infer.typed_date(raw).cast("string").alias("typed"))


@query("n9_epoch_ms_date", "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS posted FROM events")
def n9(spark, sf):
    ms = F.when(F.col("event_id") % 10 != 0, F.unix_millis(F.col("ts").cast("timestamp"))).otherwise(F.lit(0).cast("bigint"))
    return load(spark, sf, "events").select("event_id", infer.epoch_ms_date(ms).alias("posted"))


@query("n10_list_cleaning", with_tables(PART_LISTINGS) + """
SELECT pos, array_to_string(list_filter([employment_type, p_type, location], lambda x: x <> ''), '|') AS cleaned,
  CASE WHEN employment_type = '' THEN 0 ELSE 1 END AS n_single, p_type || ';' AS named FROM listings""")
def n10(spark, sf):
    named = text.names_of(F.array(F.struct(F.get("departments", F.lit(0)).alias("name")), F.struct(F.lit(None).cast("string").alias("name"))))
    return part_listings(spark, sf).select(
        "pos", F.array_join(text.drop_blanks(F.array(F.col("employment_type"), F.get("departments", F.lit(0)), F.col("location"))), "|").alias("cleaned"),
        F.size(text.singleton(F.col("employment_type"))).alias("n_single"), F.array_join(named, ";").alias("named"),
    )


@query("n11_company_from_title", with_tables(PART_LISTINGS) + """
SELECT pos, CASE WHEN pos % 3 = 0 THEN '' ELSE trim(company) END AS company FROM listings""")
def n11(spark, sf):
    headline = F.when(F.col("pos") % 3 == 0, F.col("title")).when(
        F.col("pos") % 3 == 1, F.concat("title", F.lit(" at "), "company")).otherwise(F.concat("title", F.lit(" at Home at  "), "company"))
    return part_listings(spark, sf).select("pos", text.company_from_title(headline).alias("company"))


@query("n12_company_key", with_tables(PART_LISTINGS) + f"""
SELECT pos, {company_fold('company || x')} AS ck
FROM (SELECT pos, company, ['', ' Corp', ', Inc', ' Pty Ltd.', ' GmbH', ' Co. Limited'][pos % 6 + 1] AS x FROM listings)""")
def n12(spark, sf):
    from registry.tables import pick

    name = F.concat("company", pick(["", " Corp", ", Inc", " Pty Ltd.", " GmbH", " Co. Limited"], F.col("pos") % 6))
    return part_listings(spark, sf).select("pos", infer.company_key(name).alias("ck"))


@query("n13_title_key", with_tables(PART_LISTINGS) + """
SELECT pos, trim(regexp_replace(regexp_replace(regexp_replace(trim(lower(t)), '\\([^)]*\\)', '', 'g'),
  '\\b(remote|hybrid|onsite|full.?time|part.?time|contract)\\b', '', 'g'), '\\s+', ' ', 'g')) AS tk
FROM (SELECT pos, ['', 'Full-Time ', 'Remote ', 'Contract: '][pos % 4 + 1] || title || [' (Remote, US)', '', ' - Hybrid', ' part time  role', ' Contractor'][pos % 5 + 1] AS t FROM listings)""")
def n13(spark, sf):
    from registry.tables import pick

    k = F.col("pos")
    t = F.concat(pick(["", "Full-Time ", "Remote ", "Contract: "], k % 4), "title", pick([" (Remote, US)", "", " - Hybrid", " part time  role", " Contractor"], k % 5))
    return part_listings(spark, sf).select("pos", infer.title_key(t).alias("tk"))


_MATCHED = with_tables(PART_LISTINGS).replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f""",
matched AS (SELECT pos, trim(lower(title)) AS t, trim(lower(description_text)) AS d, {company_fold('company')} AS c, {company_fold('title')} AS n FROM listings),
compared AS (SELECT t AS a, d AS b FROM matched UNION SELECT c, n FROM matched),
""" + ",\n".join(fuzzy.ratios("compared"))


@query("n14_fuzzy_match", _MATCHED + """
SELECT pos, coalesce(x.ratio, 0) AS ratio, coalesce(y.ratio, 0) >= 0.8 AS same_company
FROM matched LEFT JOIN ratios x ON x.a = t AND x.b = d LEFT JOIN ratios y ON y.a = c AND y.b = n""")
def n14(spark, sf):
    """Title of every listing against its description and its company against its brand."""
    a, b = infer.title_key("title"), infer.title_key("description_text")
    return part_listings(spark, sf).select(
        "pos", similarity.ratio(a, b).alias("ratio"), similarity.fuzzy_match(infer.company_key("company"), infer.company_key("title"), 0.8).alias("same_company")
    )


@query("n15_source_priority", with_tables(PART_LISTINGS) + f"SELECT pos, {priority()} AS priority, 99 AS unknown FROM listings")
def n15(spark, sf):
    return part_listings(spark, sf).select("pos", infer.source_priority("source").alias("priority"), infer.source_priority("company").alias("unknown"))


@query("n16_comma_list", with_tables(PART_LISTINGS) + "SELECT pos, title || '|' || company || CASE WHEN location = '' THEN '' ELSE '|' || location END AS items FROM listings")
def n16(spark, sf):
    s = F.concat(F.lit(" ,"), "title", F.lit(" , "), "company", F.lit(",,"), "location", F.lit(", "))
    return part_listings(spark, sf).select("pos", F.array_join(text.parse_comma_list(s), "|").alias("items"))


@query("n17_searchable_text", with_tables(PART_LISTINGS, DOCUMENT_LISTINGS) + f"""
SELECT 'part' AS kind, pos, md5({FULL_TEXT}) AS full_md5 FROM listings
UNION ALL SELECT 'document', pos, md5({FULL_TEXT}) FROM doc_listings""")
def n17(spark, sf):
    full = F.md5(text.searchable_text()).alias("full_md5")
    return part_listings(spark, sf).select(F.lit("part").alias("kind"), "pos", full).unionByName(
        document_listings(spark, sf).select(F.lit("document").alias("kind"), "pos", full)
    )


@query("n18_first_phrase", with_tables(PAGES, PHRASES) + """
SELECT page_id, (SELECT phrase FROM phrases WHERE contains(lower(body), phrase) ORDER BY n LIMIT 1) AS phrase FROM fetched""")
def n18(spark, sf):
    return fetched_pages(spark, sf).select("page_id", verify.expired_phrase("body").alias("phrase"))


@query("n19_generic_page", with_tables(PAGES) + """
SELECT page_id, regexp_matches(final_url, '/careers/?$|/jobs/?$|/openings/?$') AS shell,
  regexp_matches(lower(regexp_extract(final_url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '^/(careers|jobs|openings|positions)/?$') AS js FROM fetched""")
def n19(spark, sf):
    return fetched_pages(spark, sf).select("page_id", verify.is_generic_page("final_url").alias("shell"), verify.is_generic_page("final_url", "js").alias("js"))


@query("n20_board_host", with_tables(PART_LISTINGS) + "SELECT pos, source IN ('greenhouse', 'ashby') AS board FROM listings")
def n20(spark, sf):
    return part_listings(spark, sf).select("pos", verify.is_board_url("url").alias("board"))
