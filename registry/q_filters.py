"""Filters, keyword score, orders, limits and unions over whole tables."""

from pyspark.sql import functions as F

from registry.base import query
from registry.sql import COMPANIES, DOCUMENT_LISTINGS, EVENTS, FULL_TEXT, PART_LISTINGS, PART_PAGES, PROFILES, SECTOR_KEYWORDS, seniority, with_tables
from registry.tables import companies, document_listings, event_listings, load, part_listings, part_pages, profiles, sector_keywords
from vacancia.functions import text
from vacancia.functions.infer import backfill_company
from vacancia.operators import filters as fl
from vacancia.operators import match, order, report, verify
from vacancia.operators.containment import contained_terms

PART = with_tables(PART_LISTINGS)
KEYWORDS = ["senior", "widget", "economy", "Brand#1 ", "nowhere"]
EXCLUDE = ["rod"]
AS_OF = "2024-04-15"


def score_sql(keywords, columns: str, source: str, exclude=()) -> str:
    """Keyword score over rows that carry `title` and the searchable text as `full_text`."""
    listed = "[" + ", ".join(f"'{k}'" for k in keywords) + "]"
    hit = "contains({t}, lower(trim(k)))"
    keep = " AND ".join(f"NOT contains(lower(title), '{k}')" for k in exclude) or "true"
    return f"""SELECT {columns}, array_to_string(matched, '|') AS matched,
      least(round_even((3 * t + (len(matched) - t)) / (3.0 * {len(keywords)})::DOUBLE * 100, 1), 100)::DOUBLE AS score
    FROM (SELECT *, len(list_filter(matched, lambda k: {hit.format(t='lower(title)')})) AS t FROM
      (SELECT *, list_filter({listed}, lambda k: {hit.format(t='full_text')}) AS matched FROM {source} WHERE {keep}))"""


_FULL = f"(SELECT *, {FULL_TEXT} AS full_text FROM listings)"
_DOC_FULL = f"(SELECT *, {FULL_TEXT} AS full_text FROM doc_listings)"


def _scored(df, *columns):
    return df.select(*columns, F.array_join("matched_keywords", "|").alias("matched"), F.col("preliminary_relevance_score").alias("score"))


@query("f1_remote_only", PART + "SELECT pos, id, location FROM listings WHERE remote")
def f1(spark, sf):
    return fl.remote_only(part_listings(spark, sf)).select("pos", "id", "location")


@query("f2_seniority_in", PART + "SELECT pos, seniority FROM listings WHERE seniority IN ('senior', 'director')")
def f2(spark, sf):
    return fl.seniority_in(part_listings(spark, sf), ["Senior", "DIRECTOR"]).select("pos", "seniority")


@query("f3_exclude_titles", PART + "SELECT pos, title FROM listings WHERE NOT contains(lower(title), 'junior') AND NOT contains(lower(title), 'rod')")
def f3(spark, sf):
    return fl.exclude_titles(part_listings(spark, sf), ["Junior", "rod"]).select("pos", "title")


@query("f4_min_score", with_tables(PART_LISTINGS) + "SELECT * FROM (" + score_sql(KEYWORDS, "pos", _FULL) + ") WHERE score >= 30")
def f4(spark, sf):
    cfg = fl.SearchConfig(keywords=KEYWORDS, min_score=30)
    return _scored(fl.filter_and_score(part_listings(spark, sf), cfg), "pos")


@query("f5_keyword_score", with_tables(PART_LISTINGS, DOCUMENT_LISTINGS) + score_sql(KEYWORDS, "'part' AS kind, pos", _FULL, EXCLUDE)
       + "\nUNION ALL\n" + score_sql(["the", "tion", "senior", "ing", "zzz", "que", "et "], "'document' AS kind, pos", _DOC_FULL))
def f5(spark, sf):
    a = fl.score_keywords(part_listings(spark, sf), KEYWORDS, EXCLUDE)
    b = fl.score_keywords(document_listings(spark, sf), ["the", "tion", "senior", "ing", "zzz", "que", "et "])
    return _scored(a, F.lit("part").alias("kind"), "pos").unionByName(_scored(b, F.lit("document").alias("kind"), "pos"))


@query("f5_no_keywords", PART + "SELECT pos, 50.0::DOUBLE AS score FROM listings")
def f5_none(spark, sf):
    return fl.score_keywords(part_listings(spark, sf), [], ["rod"]).select("pos", F.col("preliminary_relevance_score").alias("score"))


@query("f6_drop_expired", with_tables(PART_LISTINGS, PART_PAGES) + """
SELECT url, http_code FROM part_pages WHERE NOT (http_code = 404 OR (http_code = 200 AND contains(body, 'this job is closed')))""")
def f6(spark, sf):
    return fl.drop_expired(verify.check_pages(part_pages(spark, sf))).select("url", "http_code")


@query("f7_age_bands", with_tables(EVENTS) + f"""
SELECT pos, CASE WHEN posted_date IS NULL THEN 'date unknown' WHEN date_diff('day', posted_date, DATE '{AS_OF}') < 60 THEN 'fresh' ELSE 'stale' END AS age_band
FROM event_listings WHERE posted_date IS NULL OR date_diff('day', posted_date, DATE '{AS_OF}') <= 90""")
def f7(spark, sf):
    return fl.drop_stale(event_listings(spark, sf), F.lit(AS_OF).cast("date")).select("pos", "age_band")


@query("f8_dealbreakers", PART + f"SELECT pos FROM listings WHERE work_mode IN ('remote', 'hybrid') AND NOT contains({FULL_TEXT}, 'promo') AND NOT contains({FULL_TEXT}, 'anvil')")
def f8(spark, sf):
    return fl.dealbreakers(part_listings(spark, sf), ["remote", "hybrid"], ["promo", "Anvil"]).select("pos")


@query("f9_source_query", PART + """
SELECT pos, source FROM listings WHERE departments[1] = 'ECONOMY' AND list_contains(tags, 'widget') AND contains(lower(location), 'remote')
  AND seniority <> '' AND employment_type <> '' AND employment_type = 'Full-time'
UNION ALL SELECT pos, 'level' FROM listings WHERE seniority = 'senior' AND contains(lower(location), 'berlin')
UNION ALL SELECT pos, 'page' FROM (SELECT pos, row_number() OVER (PARTITION BY source ORDER BY pos) AS n FROM listings WHERE seniority = 'mid') WHERE n > 6 AND n <= 9""")
def f9(spark, sf):
    df = part_listings(spark, sf)
    a = fl.source_query(df, fl.SourceQuery(category="economy", tag="Widget", geo="remote", equal={"employment_type": "Full-time"}))
    b = fl.source_query(df, fl.SourceQuery(level="Senior", location="Berlin"))
    c = fl.source_query(df, fl.SourceQuery(level="mid", limit=3, page=2), "pos")
    named = [x.select("pos", F.lit(name).alias("source")) for name, x in (("level", b), ("page", c))]
    return a.select("pos", "source").unionByName(named[0]).unionByName(named[1])


@query("o1_by_relevance", PART + score_sql(["senior", "widget", "economy"], "pos, id, title, company", _FULL, EXCLUDE))
def o1(spark, sf):
    df = fl.filter_and_score(part_listings(spark, sf), fl.SearchConfig(["senior", "widget", "economy"], exclude_keywords=EXCLUDE))
    return _scored(order.by_relevance(df, "pos"), "pos", "id", "title", "company")


@query("o2_top_per_source", PART + "SELECT pos, source FROM listings QUALIFY row_number() OVER (PARTITION BY source ORDER BY posted_date_raw DESC, pos) <= 20")
def o2(spark, sf):
    return order.top_per_source(part_listings(spark, sf), 20, F.desc("posted_date_raw"), "pos").select("pos", "source")


@query("u1_union_channels", with_tables(PART_LISTINGS, DOCUMENT_LISTINGS) + """
SELECT pos, id, title, location FROM listings UNION ALL SELECT pos, id, title, location FROM doc_listings""")
def u1(spark, sf):
    return report.union_channels(part_listings(spark, sf), None, document_listings(spark, sf)).select("pos", "id", "title", "location")


@query("u2_union_keywords", with_tables(PROFILES, SECTOR_KEYWORDS) + """
SELECT profile_id, unnest(list_distinct(list_concat(keywords, skills))) AS keyword FROM profiles
UNION SELECT profile_id, keyword FROM (SELECT profile_id, unnest(sectors) AS sector FROM profiles) JOIN sector_keywords USING (sector)""")
def u2(spark, sf):
    return match.profile_keywords(profiles(spark, sf), sector_keywords(spark, sf))


@query("m12_backfill_company", PART + "SELECT pos, CASE WHEN pos % 4 = 0 THEN lower(company) ELSE company END AS company FROM listings")
def m12(spark, sf):
    df = part_listings(spark, sf)
    blank = F.when(F.col("pos") % 4 == 0, "").otherwise(F.col("company"))
    return df.select("pos", backfill_company(blank, F.lower("company")).alias("company"))


@query("j1_target_companies", with_tables(PROFILES, COMPANIES) + """
SELECT profile_id, name, ats, slug FROM profiles JOIN companies ON list_contains(sectors, s1) OR list_contains(sectors, s2)""")
def j1(spark, sf):
    return match.target_companies(companies(spark, sf), profiles(spark, sf)).select("profile_id", "name", "ats", "slug")


@query("j3_sector_terms", with_tables(PROFILES, SECTOR_KEYWORDS) + """
SELECT profile_id, keyword FROM (SELECT profile_id, unnest(sectors) AS sector FROM profiles) JOIN sector_keywords USING (sector)
UNION SELECT profile_id, unnest(list_concat(keywords, skills)) FROM profiles""")
def j3(spark, sf):
    return match.profile_keywords(profiles(spark, sf), sector_keywords(spark, sf))


@query("j4_keyword_hits", with_tables(PART_LISTINGS, DOCUMENT_LISTINGS) + f"""
SELECT 'part' AS kind, pos, k AS keyword FROM (SELECT pos, {FULL_TEXT} AS f, unnest(['red', 'bolt', 'brand#2', 'work on']) AS k FROM listings) WHERE contains(f, k)
UNION ALL SELECT 'document', pos, k FROM (SELECT pos, {FULL_TEXT} AS f, unnest(['tion', 'src1', 'the ']) AS k FROM doc_listings) WHERE contains(f, trim(k))""")
def j4(spark, sf):
    def hits(df, kind, words):
        return match.with_required_skills(df, words).select(F.lit(kind).alias("kind"), "pos", F.explode("required_skills").alias("keyword"))

    return hits(part_listings(spark, sf), "part", ["red", "bolt", "brand#2", "work on"]).unionByName(
        hits(document_listings(spark, sf), "document", ["tion", "src1", "the "]))


def dictionary_terms(spark, sf):
    """Thousands of terms of one to many letters: words of benchmark texts, phrases of parts, ends of customer names."""
    words = load(spark, sf, "benchmark").select(F.explode(F.split("text", " ")).alias("w"))
    phrases = load(spark, sf, "part").select(F.concat("p_type", F.lit(" line "), "p_name"))
    return words.union(phrases).union(load(spark, sf, "customer").select(F.substring("c_name", 10, 2))).filter("w <> ''").select(F.lower("w").alias("term")).distinct()


@query("j4_dictionary_terms", with_tables(PART_LISTINGS, DOCUMENT_LISTINGS) + f"""SELECT kind, pos, count(*) AS terms, md5(string_agg(term, ',' ORDER BY term)) AS digest FROM (
  SELECT kind, pos, term FROM (SELECT 'part' AS kind, pos, {FULL_TEXT} AS f FROM listings UNION ALL SELECT 'document', pos, {FULL_TEXT} FROM doc_listings),
    (SELECT DISTINCT lower(w) AS term FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark UNION ALL SELECT p_type || ' line ' || p_name FROM part UNION ALL SELECT substr(c_name, 10, 2) FROM customer) WHERE w <> '')
  WHERE contains(f, term)) GROUP BY kind, pos""")
def j4_dictionary(spark, sf):
    """Which terms of a dictionary table each listing holds."""
    texts = [df.select(F.concat(F.lit(f"{kind} "), F.col("pos").cast("string")).alias("key"), text.searchable_text().alias("full"))
             for kind, df in (("part", part_listings(spark, sf)), ("document", document_listings(spark, sf)))]
    found = contained_terms(texts[0].union(texts[1]), "key", "full", dictionary_terms(spark, sf))
    digest = F.md5(F.array_join(F.sort_array(F.collect_list("term")), ","))
    out = found.groupBy("key").agg(F.count("*").alias("terms"), digest.alias("digest"))
    at = F.split("key", " ")
    return out.select(at[0].alias("kind"), at[1].cast("bigint").alias("pos"), "terms", "digest")
