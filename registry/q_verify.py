"""Liveness checks and status merges over whole tables."""

from pyspark.sql import functions as F

from registry.base import query
from registry.q_filters import AS_OF
from registry.sql import PAGES, PART_LISTINGS, PART_PAGES, PHRASES, with_tables
from registry.tables import fetched_pages, part_listings, part_pages
from vacancia.operators import verify
from vacancia.plans.search import search_pool
from vacancia.session import scratch_path
from vacancia.sources import landing

_BASE = with_tables(PAGES, PHRASES) + """, looked AS (
  SELECT *, (SELECT phrase FROM phrases WHERE contains(lower(body), phrase) ORDER BY n LIMIT 1) AS phrase,
    final_url <> url AND regexp_matches(final_url, '/(careers|jobs|openings)/?$') AS moved,
    final_url <> url AND regexp_matches(lower(regexp_extract(final_url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '^/(careers|jobs|openings|positions)/?$') AS moved_js
  FROM fetched),
shell AS (
  SELECT page_id, url, http_code,
    CASE WHEN http_code IN (404, 410) THEN 'EXPIRED' WHEN http_code NOT IN (200, 301, 302) THEN 'UNVERIFIABLE' WHEN body = '' THEN 'UNVERIFIABLE'
      WHEN phrase IS NOT NULL OR moved THEN 'EXPIRED' ELSE 'VERIFIED' END AS status,
    CASE WHEN http_code IN (404, 410) THEN 'HTTP ' || http_code || ' response' WHEN http_code IN (0, 403) THEN 'Connection failed or access denied'
      WHEN http_code NOT IN (200, 301, 302) THEN 'Unexpected HTTP status' WHEN body = '' THEN 'Empty response body'
      WHEN phrase IS NOT NULL THEN 'Page contains: ' || phrase WHEN moved THEN 'Redirected to generic careers page: ' || final_url
      ELSE 'Page loads with no expired indicators' END AS reason
  FROM looked),
js AS (
  SELECT url, http_code,
    CASE WHEN http_code IN (404, 410) THEN 'EXPIRED' WHEN http_code = 0 OR http_code >= 400 THEN 'UNVERIFIABLE' WHEN phrase IS NOT NULL OR moved_js THEN 'EXPIRED' ELSE 'VERIFIED' END AS status,
    CASE WHEN http_code IN (404, 410) THEN 'HTTP ' || http_code || ' response' WHEN http_code = 403 THEN 'Access denied' WHEN http_code = 0 OR http_code >= 400 THEN 'HTTP ' || http_code
      WHEN phrase IS NOT NULL THEN 'Page contains: "' || phrase || '"' WHEN moved_js THEN 'Redirected to generic page: ' || final_url
      ELSE 'Page loads with no expired indicators' END AS reason
  FROM looked)
"""
_PART_CHECKS = with_tables(PART_LISTINGS, PART_PAGES) + """, checks AS (
  SELECT url, CASE WHEN http_code = 404 THEN 'EXPIRED' WHEN http_code <> 200 THEN 'UNVERIFIABLE' WHEN contains(body, 'this job is closed') THEN 'EXPIRED' ELSE 'VERIFIED' END AS status FROM part_pages)
"""


def _checks(spark, sf):
    return verify.check_pages(part_pages(spark, sf))


@query("s19_fetched_pages", with_tables(PAGES) + "SELECT url, http_code, final_url, md5(body) AS body_md5 FROM fetched")
def s19(spark, sf):
    path = scratch_path(spark, "fetched")
    fetched_pages(spark, sf).select("url", "http_code", "final_url", "body").write.parquet(path)
    return landing.scan_pages(spark, path).select("url", "http_code", "final_url", F.md5("body").alias("body_md5"))


@query("v1_status_class", _BASE + """SELECT page_id, CASE WHEN http_code IN (404, 410) THEN 'EXPIRED' WHEN http_code NOT IN (200, 301, 302) THEN 'UNVERIFIABLE' END AS shell,
  CASE WHEN http_code IN (404, 410) THEN 'EXPIRED' WHEN http_code = 0 OR http_code >= 400 THEN 'UNVERIFIABLE' END AS js FROM fetched""")
def v1(spark, sf):
    return fetched_pages(spark, sf).select("page_id", verify.status_class("http_code").alias("shell"), verify.status_class("http_code", "js").alias("js"))


@query("v2_empty_body", _BASE + "SELECT url, status FROM shell WHERE reason = 'Empty response body'")
def v2(spark, sf):
    return verify.check_pages(fetched_pages(spark, sf)).filter("reason = 'Empty response body'").select("url", "status")


@query("v3_expired_phrase", _BASE + "SELECT url, status, reason FROM shell WHERE starts_with(reason, 'Page contains')")
def v3(spark, sf):
    return verify.check_pages(fetched_pages(spark, sf)).filter("startswith(reason, 'Page contains')").select("url", "status", "reason")


@query("v4_generic_redirect", _BASE + "SELECT url, status, reason FROM shell WHERE starts_with(reason, 'Redirected')")
def v4(spark, sf):
    return verify.check_pages(fetched_pages(spark, sf)).filter("startswith(reason, 'Redirected')").select("url", "status", "reason")


@query("v5_check_pages", _BASE + "SELECT url, status, http_code, reason FROM shell")
def v5(spark, sf):
    return verify.check_pages(fetched_pages(spark, sf))


@query("v5_check_pages_js", _BASE + "SELECT url, status, http_code, reason FROM js")
def v5_js(spark, sf):
    return verify.check_pages(fetched_pages(spark, sf), "js")


@query("v6_merge_status", _PART_CHECKS + """
SELECT pos, CASE WHEN verification_status = 'GUARANTEED' THEN verification_status ELSE coalesce(status, verification_status) END AS verification_status
FROM listings LEFT JOIN checks USING (url) WHERE verification_status = 'GUARANTEED' OR coalesce(status, '') <> 'EXPIRED'""")
def v6(spark, sf):
    return verify.merge_status(part_listings(spark, sf), _checks(spark, sf)).select("pos", "verification_status")


@query("j6_listing_checks", _PART_CHECKS + """
SELECT pos, CASE WHEN verification_status <> 'GUARANTEED' THEN status END AS check_status FROM listings LEFT JOIN checks USING (url)""")
def j6(spark, sf):
    return verify.join_checks(part_listings(spark, sf), _checks(spark, sf)).select("pos", "check_status")


@query("v7_search_status", with_tables(PART_LISTINGS) + """
SELECT pos, CASE WHEN source IN ('greenhouse', 'ashby') THEN 'GUARANTEED' WHEN pos % 2 = 0 THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS status FROM listings""")
def v7(spark, sf):
    return part_listings(spark, sf).select("pos", verify.search_status("url", F.col("pos") % 2 == 0).alias("status"))


@query("v8_pool_notice", _PART_CHECKS + """
SELECT count(*) AS pool_size, count(*) < 10 AS small_pool FROM listings LEFT JOIN checks USING (url) WHERE verification_status = 'GUARANTEED' OR coalesce(status, '') <> 'EXPIRED'""")
def v8(spark, sf):
    return verify.pool_notice(verify.merge_status(part_listings(spark, sf), _checks(spark, sf)))


_SEARCH = _PART_CHECKS.rstrip() + f""", named AS (SELECT * REPLACE (CASE WHEN pos % 50 = 7 THEN '' ELSE company END AS company, CASE WHEN pos % 50 = 7 THEN '' ELSE title END AS title) FROM listings),
hits AS (
  SELECT pos * 2 AS place, 'snippet' AS kind, source, company, title, location, NULL::DOUBLE AS salary_min, NULL::DOUBLE AS salary_max, CASE WHEN pos % 2 = 0 THEN posted_date END AS posted_date,
    '' AS description_text, '' AS employment_type, url FROM named
  UNION ALL SELECT pos * 2 + 1, 'filled', source, company, title, location, salary_min, salary_max, posted_date, description_text, employment_type, url FROM named WHERE pos % 3 <> 0),
best AS (
  SELECT * FROM hits WHERE company = '' AND title = ''
  UNION ALL SELECT * FROM hits WHERE company <> '' OR title <> '' QUALIFY row_number() OVER (PARTITION BY lower(company), lower(title) ORDER BY
    (location <> '')::INT + (salary_min IS NOT NULL)::INT + (salary_max IS NOT NULL)::INT + (posted_date IS NOT NULL)::INT + (description_text <> '')::INT + (employment_type <> '')::INT DESC,
    length(description_text) DESC, place) = 1)
SELECT place, kind, CASE WHEN posted_date IS NULL THEN 'date unknown' WHEN date_diff('day', posted_date, DATE '{AS_OF}') < 60 THEN 'fresh' ELSE 'stale' END AS age_band,
  CASE WHEN source IN ('greenhouse', 'ashby') THEN 'GUARANTEED' WHEN status = 'VERIFIED' THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS verification_status
FROM best LEFT JOIN checks USING (url)
WHERE (posted_date IS NULL OR date_diff('day', posted_date, DATE '{AS_OF}') <= 90) AND (source IN ('greenhouse', 'ashby') OR coalesce(status, '') <> 'EXPIRED')"""


@query("v9_search_pool", _SEARCH)
def v9(spark, sf):
    """A snippet of every listing and, of two thirds, the filled-in row; a fiftieth has neither company nor title."""
    rows, nameless, nothing = part_listings(spark, sf), F.col("pos") % 50 == 7, F.lit(None)
    named = rows.withColumns({c: F.when(nameless, "").otherwise(F.col(c)) for c in ("company", "title")})
    snippet = named.withColumns({
        "place": F.col("pos") * 2, "kind": F.lit("snippet"), "salary_min": nothing.cast("double"), "salary_max": nothing.cast("double"),
        "posted_date": F.when(F.col("pos") % 2 == 0, F.col("posted_date")), "description_text": F.lit(""), "employment_type": F.lit("")})
    filled = named.filter(F.col("pos") % 3 != 0).withColumns({"place": F.col("pos") * 2 + 1, "kind": F.lit("filled")})
    pool = search_pool(snippet.unionByName(filled), _checks(spark, sf), F.lit(AS_OF).cast("date"), "place")
    return pool.select("place", "kind", "age_band", "verification_status")
