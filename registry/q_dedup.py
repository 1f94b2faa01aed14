"""Order, matching and merging of duplicates over whole tables.

Every merge step is registered twice: over clusters of equal match keys and over clusters of similar ones, whose
SQL computes the ratio itself (`registry.fuzzy`).
"""

from pyspark.sql import functions as F

from registry import fuzzy
from registry.base import query
from registry.sql import PART_LISTINGS, company_fold, priority, with_tables
from registry.tables import part_listings
from vacancia.operators import dedup, order
from vacancia.schema import API_SOURCES
from vacancia.session import materialize

KEYED = with_tables(PART_LISTINGS) + f""", keyed AS (
  SELECT *, row_number() OVER (ORDER BY priority, pos) - 1 AS ord, {company_fold('company')} AS ck, trim(lower(title)) AS tk FROM listings),
clusters AS (SELECT *, min(ord) OVER (PARTITION BY ck, tk) AS leader FROM keyed)
"""
FUZZY = KEYED.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ",\n" + ",\n".join(fuzzy.key_ratios("keyed") + fuzzy.leaders("keyed")) + "\n"
_FILLS = {"salary_min": "nullif(salary_min, 0)", "salary_max": "nullif(salary_max, 0)", "salary_currency": "nullif(salary_currency, '')",
          "posted_date_raw": "nullif(posted_date_raw, '')", "employment_type": "nullif(employment_type, '')"}


def ordered(spark, sf):
    return order.by_source_priority(dedup.with_match_keys(part_listings(spark, sf)), "pos")


def ordered_keys(spark, sf):
    """pos, source, ck, tk in order: matching reads no other column, so the range sort moves none."""
    keys = dedup.with_match_keys(part_listings(spark, sf)).select("pos", "source", "ck", "tk")
    return order.by_source_priority(keys, "pos")


def fuzzy_clusters(spark, sf):
    return materialize(dedup.assign_clusters(ordered(spark, sf)), "clusters")


def exact_clusters(spark, sf):
    rows = ordered(spark, sf)
    first = rows.groupBy("ck", "tk").agg(F.min("ord").alias("leader"))
    return rows.join(first, ["ck", "tk"])


@query("d1_priority_order", KEYED + "SELECT pos, source, priority, ord FROM keyed")
def d1(spark, sf):
    return order.by_source_priority(part_listings(spark, sf), "pos").select("pos", "source", "priority", "ord")


@query("d2_duplicate_keys", KEYED + "SELECT pos, ck, tk, leader FROM clusters")
def d2_keys(spark, sf):
    """Match keys and the first row with the same keys: the exact part of the duplicate test."""
    return exact_clusters(spark, sf).select("pos", "ck", "tk", "leader")


@query("j5_fuzzy_pairs", FUZZY + "SELECT earlier, later FROM edges")
def j5(spark, sf):
    """Every matching pair of distinct keys, earlier and later."""
    return dedup.duplicate_edges(dedup.match_nodes(ordered_keys(spark, sf)))


@query("j5_match_classes", FUZZY + """
SELECT f.ord, f.leader, coalesce(links, 0) AS links, CASE WHEN f.ck = '' OR f.tk = '' THEN 0.0 ELSE r.ratio END AS title_ratio
FROM fuzzy f JOIN keyed l ON l.ord = f.leader LEFT JOIN tk_ratio r ON r.a = f.tk AND r.b = l.tk
LEFT JOIN (SELECT ck, tk, count(*) AS links FROM (SELECT earlier_ck AS ck, earlier_tk AS tk FROM edges UNION ALL SELECT later_ck, later_tk FROM edges) GROUP BY ck, tk) n ON n.ck = f.ck AND n.tk = f.tk""")
def j5_classes(spark, sf):
    """Matches as classes: every row with its leader, its title's ratio to the leader's and how many other keys its own key matches."""
    return dedup.match_classes(materialize(ordered_keys(spark, sf).select("ord", "ck", "tk"), "rows")).select("ord", "leader", "links", "title_ratio")


@query("d2_duplicate_predicate", FUZZY + "SELECT earlier, later, earlier_ck, earlier_tk, later_ck, later_tk FROM edges")
def d2(spark, sf):
    """The pairs again with their titles and companies, as the predicate's verdict reads."""
    rows = materialize(ordered_keys(spark, sf).select("ord", "ck", "tk"), "rows")
    edges = dedup.duplicate_edges(dedup.match_nodes(rows))
    a = rows.select(F.col("ord").alias("later"), F.col("ck").alias("later_ck"), F.col("tk").alias("later_tk"))
    b = rows.select(F.col("ord").alias("earlier"), F.col("ck").alias("earlier_ck"), F.col("tk").alias("earlier_tk"))
    return edges.join(a, "later").join(b, "earlier")


@query("d3_leader_clusters", FUZZY + "SELECT pos, ord, leader FROM fuzzy")
def d3(spark, sf):
    return fuzzy_clusters(spark, sf).select("pos", "ord", "leader")


def _first_filled(c: str, value: str) -> str:
    kept = f"first({value} ORDER BY ord) FILTER ({value} IS NOT NULL)"
    return f"{kept} AS {c}" if c.startswith("salary_") else f"coalesce({kept}, '') AS {c}"


_FILLED = ", ".join(_first_filled(c, v) for c, v in _FILLS.items())


@query("d4_fill_fields", KEYED + f"SELECT leader AS ord, {_FILLED} FROM clusters GROUP BY leader")
def d4(spark, sf):
    return dedup.fill_fields(exact_clusters(spark, sf)).select("ord", *_FILLS)


@query("d4_fill_fields_fuzzy", FUZZY + f"SELECT leader AS ord, first(id ORDER BY ord) AS id, {_FILLED} FROM fuzzy GROUP BY leader")
def d4_fuzzy(spark, sf):
    return dedup.fill_fields(fuzzy_clusters(spark, sf)).select("ord", "id", *_FILLS)


@query("d4_dates", KEYED + """, dated AS (
  SELECT leader, ord, CASE WHEN pos % 3 = 0 THEN '' WHEN pos % 3 = 1 THEN 'soon' ELSE posted_date_raw END AS raw, CASE WHEN pos % 3 = 2 THEN posted_date END AS typed FROM clusters)
SELECT leader AS ord, coalesce(first(raw ORDER BY ord) FILTER (raw <> ''), '') AS posted_date_raw,
  strftime(first(typed ORDER BY ord) FILTER (raw <> ''), '%Y-%m-%d') AS posted_date FROM dated GROUP BY leader""")
def d4_dates(spark, sf):
    """A third of the dates is blank and a third unreadable: the typed date is that of the row whose text counts."""
    rest = F.col("pos") % 3
    raw = F.when(rest == 0, "").when(rest == 1, "soon").otherwise(F.col("posted_date_raw"))
    rows = exact_clusters(spark, sf).withColumns({"posted_date_raw": raw, "posted_date": F.when(rest == 2, F.col("posted_date"))})
    return dedup.fill_fields(rows).select("ord", "posted_date_raw", F.col("posted_date").cast("string").alias("posted_date"))


_TAGS = """, tagged AS (SELECT leader, ord, unnest(tags) AS tag, generate_subscripts(tags, 1) - 1 AS tag_pos FROM {clusters})
SELECT leader, ord, tag_pos, tag FROM tagged QUALIFY ord = min(ord) OVER (PARTITION BY leader, tag)"""


@query("d5_merge_tags", KEYED + _TAGS.format(clusters="clusters"))
def d5(spark, sf):
    return dedup.merged_tags(exact_clusters(spark, sf)).withColumnRenamed("pos", "tag_pos")


@query("d5_merge_tags_fuzzy", FUZZY + _TAGS.format(clusters="fuzzy"))
def d5_fuzzy(spark, sf):
    return dedup.merged_tags(fuzzy_clusters(spark, sf)).withColumnRenamed("pos", "tag_pos")


@query("d6_alternate_sources", KEYED + "SELECT leader, ord, source, url, source_id FROM clusters WHERE ord <> leader")
def d6(spark, sf):
    return dedup.alternate_sources(exact_clusters(spark, sf)).drop("pos")


@query("d6_alternate_sources_fuzzy", FUZZY + "SELECT leader, ord, source, url, source_id FROM fuzzy WHERE ord <> leader")
def d6_fuzzy(spark, sf):
    return dedup.alternate_sources(fuzzy_clusters(spark, sf)).drop("pos")


_API = "'" + "', '".join(API_SOURCES) + "'"
TWO_STAGE = KEYED.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ",\n" + ",\n".join([
    *fuzzy.key_ratios("keyed"),
    f"keyed1 AS MATERIALIZED (SELECT pos, source, url, source_id, priority, ck, tk, row_number() OVER (ORDER BY priority, pos) - 1 AS ord FROM keyed WHERE source IN ({_API}))",
    *fuzzy.leaders("keyed1", "1"),
    f"""keyed2 AS MATERIALIZED (
  SELECT pos, source, url, source_id, ck, tk, row_number() OVER (ORDER BY priority, pos) - 1 AS ord FROM keyed
  WHERE source NOT IN ({_API}) OR pos IN (SELECT pos FROM fuzzy1 WHERE ord = leader))""",
    *fuzzy.leaders("keyed2", "2"),
]) + """
SELECT leader, ord, 0 AS place, source, url, source_id FROM fuzzy2 WHERE ord <> leader
UNION ALL SELECT s.leader, s.ord, row_number() OVER (PARTITION BY a.leader ORDER BY a.ord) - 1, a.source, a.url, a.source_id
FROM fuzzy1 a JOIN fuzzy1 h ON h.ord = a.leader JOIN fuzzy2 s ON s.pos = h.pos WHERE a.ord <> a.leader AND s.ord = s.leader"""


@query("d6_two_stage", TWO_STAGE)
def d6_two_stage(spark, sf):
    """Listings of the search services are merged first, their survivors then with all others; alternates of both stages."""
    rows = part_listings(spark, sf)
    api = F.col("source").isin(*API_SOURCES)
    first = dedup.nested(dedup.deduplicate(rows.filter(api), "pos"))
    both = dedup.deduplicate(first.unionByName(rows.filter(~api), allowMissingColumns=True), "pos")
    return both.alternates.withColumnRenamed("pos", "place")


@query("d7_final_order", KEYED + f"""
SELECT ord, row_number() OVER (ORDER BY score DESC, {priority()}, ord) - 1 AS place FROM (
  SELECT ord, source, CASE WHEN pos % 4 = 0 THEN 0 ELSE salary_min % 7 END AS raw, coalesce(raw, 0) AS score FROM clusters WHERE ord = leader)""")
def d7(spark, sf):
    scored = exact_clusters(spark, sf).filter("ord = leader").withColumn(
        "preliminary_relevance_score", F.when(F.col("pos") % 4 != 0, F.col("salary_min") % 7)
    )
    return dedup.final_position(scored).select("ord", "place")


_STATS = "SELECT count(*) AS total_input, count(*) FILTER (ord = leader) AS total_output, count(*) FILTER (ord <> leader) AS duplicates_removed FROM {clusters}"


@query("d8_dedup_stats", KEYED + _STATS.format(clusters="clusters"))
def d8(spark, sf):
    return dedup.dedup_stats(exact_clusters(spark, sf))


@query("d8_dedup_stats_fuzzy", FUZZY + _STATS.format(clusters="fuzzy"))
def d8_fuzzy(spark, sf):
    return dedup.dedup_stats(fuzzy_clusters(spark, sf))


@query("j7_most_detailed", KEYED + """
SELECT pos, source FROM listings QUALIFY row_number() OVER (PARTITION BY lower(company), lower(title) ORDER BY
  (location <> '')::INT + (salary_min IS NOT NULL)::INT + (salary_max IS NOT NULL)::INT + (posted_date IS NOT NULL)::INT + (description_text <> '')::INT + (employment_type <> '')::INT DESC,
  length(description_text) DESC, pos) = 1""")
def j7(spark, sf):
    return dedup.keep_most_detailed(part_listings(spark, sf), "pos").select("pos", "source")
