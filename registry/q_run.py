"""The whole run: from landed boards, feeds, pages and dimensions to tiers and all nine report sections."""

from pyspark.sql import functions as F

from registry import openings as op
from registry.base import query
from registry.sql import FULL_TEXT, PROFILES, SECTOR_KEYWORDS, priority, seniority, with_tables, work_mode
from registry.tables import ADJECTIVES, NOUNS, profiles
from vacancia.operators import sinks
from vacancia.operators.filters import SearchConfig
from vacancia.plans import matching
from vacancia.session import scratch_path

AS_OF = "2024-04-15"
_SEC = "['economy','small','standard','medium','promo','large']"
_LEVELS = "['junior','mid','senior','director','executive']"
_DESC = "'Work on ' || p_type || p_name || ' & more'"
_AGE = f"date_diff('day', d, DATE '{AS_OF}')"
_COLUMNS = "k, doc, co, t, d, p_type, p_name"


def _listed(source, title, company, mode, level, salary, desc, tags, url, status, where):
    low, high, currency = salary
    return f"""SELECT {_COLUMNS}, '{source}' AS source, {title} AS title, {company} AS company, {mode} AS work_mode, {level} AS seniority, {low}::DOUBLE AS salary_min, {high}::DOUBLE AS salary_max,
      {currency}::VARCHAR AS salary_currency, {desc} AS description_text, [p_type] AS departments, {tags} AS tags, {url} || k AS url, '{status}' AS verification_status FROM p WHERE {where}"""


_NONE = ("NULL", "NULL", "NULL")
_READ = "doc % 9 <> 4"  # the other documents of boards break off
RUN = with_tables(PROFILES, SECTOR_KEYWORDS) + f""",
p AS (SELECT p_partkey AS k, p_partkey // 50 AS doc, p_name, p_type, ['Director of ','Senior ','','Junior '][p_partkey % 4 + 1] || p_name || ' ' || md5(p_partkey::VARCHAR) || md5((p_partkey + 7)::VARCHAR) AS t,
    'Firm ' || md5((p_partkey // 50)::VARCHAR) AS co, (DATE '2024-01-01' + CAST(p_partkey % 120 AS INTEGER))::DATE AS d, ['Remote','Hybrid - Berlin','Remote / office','NYC',''][p_size % 5 + 1] AS place FROM part),
landed AS (
  {_listed('greenhouse', 't', "co || ' Inc'", work_mode('place'), seniority('t'), _NONE, _DESC, '[]::VARCHAR[]', "'https://boards.greenhouse.io/x/'", 'GUARANTEED', f'k % 2 = 0 AND {_READ}')}
  UNION ALL {_listed('remotive', "t || ' (Remote)'", 'co', "'remote'", seniority('t'), _NONE, _DESC, "string_split(p_name, ' ')", "'https://r/'", 'API_ACTIVE', f'k % 5 < 2 AND {_READ}')}
  UNION ALL {_listed('himalayas', 't', "co || ' LLC'", "'remote'", f"CASE WHEN k % 3 = 0 THEN 'Senior Level' ELSE {seniority('t')} END", ('k', '2 * k', "'USD'"), _DESC, "['x']", "'https://h/'", 'API_ACTIVE', f'(k % 7 = 0 OR k % 5 = 2) AND {_READ}')}
  UNION ALL {_listed('rss', 't', 'co', "'onsite'", seniority('t'), _NONE, 'p_type', '[]::VARCHAR[]', "'https://f/'", 'UNVERIFIED', 'k % 3 <> 1')}),
kept AS (SELECT *, list_filter({op.KEYWORDS}, lambda w: contains({FULL_TEXT}, w)) AS matched,
    replace(lower(title), ' (remote)', '') AS tk, regexp_replace(lower(company), ' (inc|llc)$', '') AS ck FROM landed
  WHERE {" AND ".join(f"NOT contains(lower(title), '{w}')" for w in op.EXCLUDE)}),
members AS (SELECT *, row_number() OVER c AS n, max(salary_min) OVER w AS low, max(salary_max) OVER w AS high, max(salary_currency) OVER w AS currency,
    flatten(list(tags) OVER w) AS all_tags FROM kept
  WINDOW w AS (PARTITION BY ck, tk), c AS (PARTITION BY ck, tk ORDER BY {priority()}, source)),
pages AS (SELECT DISTINCT k, [200,200,404,403,200,500,200][k % 7 + 1] AS code, k % 8 = 3 AS closed FROM p WHERE k % 10 <> 4),
checked AS (SELECT m.* REPLACE (low AS salary_min, high AS salary_max, currency AS salary_currency, all_tags AS tags,
      CASE WHEN source = 'greenhouse' OR code IS NULL THEN verification_status WHEN code IN (403, 500) THEN 'UNVERIFIABLE' ELSE 'VERIFIED' END AS verification_status),
    coalesce(source <> 'greenhouse' AND (code = 404 OR (code = 200 AND closed)), false) AS expired
  FROM members m LEFT JOIN pages USING (k) WHERE n = 1),
cur AS (SELECT *, {FULL_TEXT} AS full_text FROM checked WHERE NOT expired AND {_AGE} <= 90),
asking AS (SELECT p.*, coalesce((SELECT list(DISTINCT s.keyword) FROM sector_keywords s WHERE list_contains(p.sectors, s.sector)), []) AS sector_terms FROM profiles p),
pairs AS (SELECT l.*, a.*, list_filter({ADJECTIVES + NOUNS}, lambda w: contains(full_text, w)) AS required,
    CASE WHEN doc % 2 = 0 THEN [{_SEC}[doc % 6 + 1]] ELSE [] END AS company_sectors FROM cur l CROSS JOIN asking a
  WHERE list_contains(work_modes, work_mode) AND NOT contains(full_text, dealbreaker_terms[1])),
points AS (SELECT *, round_even(
    CASE WHEN len(required) = 0 THEN 15 ELSE 30::DOUBLE * len(list_intersect(required, skills)) / len(required) END
    + coalesce(greatest(0::DOUBLE, 20 - 10::DOUBLE * list_min(list_transform(seniority_targets, lambda s: abs(list_position({_LEVELS}, s) - list_position({_LEVELS}, seniority))))), 0)
    + CASE WHEN len(list_filter(sector_terms, lambda s: contains(lower(title), s))) > 0 OR list_has_any(sectors, company_sectors) THEN 20
        WHEN len(list_filter(sector_terms, lambda s: contains(full_text, s))) > 0 THEN 10 ELSE 0 END::DOUBLE
    + CASE WHEN list_contains(work_modes, work_mode) THEN 15 WHEN work_mode = 'hybrid' OR list_contains(work_modes, 'hybrid') THEN 7.5 ELSE 0 END::DOUBLE
    + 10::DOUBLE * len(list_filter(value_terms, lambda s: contains(full_text, s))) / len(value_terms)
    + CASE WHEN {_AGE} <= 30 THEN 5 ELSE greatest(0, 5::DOUBLE * (90 - {_AGE}) / 60) END::DOUBLE, 1) AS match_score FROM pairs),
tiered AS (SELECT * FROM (SELECT *, CASE WHEN match_score >= 80 THEN 1 WHEN match_score >= 60 THEN 2 WHEN match_score >= 40 THEN 3 END AS tier FROM points) WHERE tier IS NOT NULL),
gaps AS (SELECT profile_id, skill, count(*) AS demand FROM (SELECT profile_id, unnest(required) AS skill, skills FROM tiered) WHERE NOT list_contains(skills, skill) GROUP BY ALL)
"""
_CHANNEL = "CASE source WHEN 'greenhouse' THEN 'ats' WHEN 'rss' THEN 'rss' ELSE 'api' END"
SECTIONS = RUN + f"""
SELECT 'sources' AS section, source AS a, NULL AS b, count(*) AS listings, count(DISTINCT company)::DOUBLE AS x, NULL::DOUBLE AS y, NULL::DOUBLE AS z FROM cur GROUP BY source
UNION ALL SELECT 'verification', verification_status, NULL, count(*), NULL, NULL, NULL FROM cur GROUP BY verification_status
UNION ALL SELECT 'salaries', salary_currency, seniority, count(*), min(salary_min), max(salary_max), quantile_disc(salary_min, 0.5) FROM cur WHERE salary_min IS NOT NULL GROUP BY salary_currency, seniority
UNION ALL SELECT 'demand', w, NULL, count(*), NULL, NULL, NULL FROM (SELECT unnest(matched) AS w FROM cur) GROUP BY w
UNION ALL SELECT 'tiers', profile_id, tier::VARCHAR, count(*), max(match_score), NULL, NULL FROM tiered GROUP BY profile_id, tier
UNION ALL SELECT 'gaps', profile_id, skill, demand, ntile(3) OVER (PARTITION BY profile_id ORDER BY demand DESC, skill)::DOUBLE, NULL, NULL FROM gaps
UNION ALL SELECT 'channels', channel, source, count(*), NULL, NULL, NULL FROM (SELECT source, {_CHANNEL} AS channel FROM cur) GROUP BY ROLLUP (channel, source)
UNION ALL SELECT 'coverage', source, NULL, count(*), avg(CASE WHEN salary_min IS NOT NULL THEN 1.0 ELSE 0.0 END), NULL, NULL FROM cur GROUP BY source
UNION ALL SELECT 'pool', (count(*) < 10)::VARCHAR, NULL, count(*), NULL, NULL, NULL FROM cur"""


def whole_run(spark, sf) -> tuple[matching.Matched, str]:
    path = scratch_path(spark, "report")
    cfg = SearchConfig(op.KEYWORDS, exclude_keywords=op.EXCLUDE)
    return matching.run(spark, op.land_all(spark, sf), cfg, profiles(spark, sf), ADJECTIVES + NOUNS, F.lit(AS_OF).cast("date"), path), path


# Columns of each section in one shape: two names, a count and up to three numbers.
_SHAPE = {
    "sources": ("source", None, "listings", "companies"), "verification": ("verification_status", None, "listings"),
    "salaries": ("salary_currency", "seniority", "listings", "lowest", "highest", "median_min"), "demand": ("keyword", None, "listings"),
    "tiers": ("profile_id", "tier", "listings", "best_score"), "gaps": ("profile_id", "skill", "demand", "importance"),
    "channels": ("channel", "source", "listings"), "coverage": ("source", None, "listings", "salary_share"), "pool": ("small_pool", None, "pool_size"),
}


@query("w1_whole_run", SECTIONS)
def w1(spark, sf):
    """All nine sections as read back from the committed report."""
    _, path = whole_run(spark, sf)
    out = None
    for name, section in sinks.read_report(spark, path).items():
        a, b, n, *numbers = _SHAPE[name]
        if name == "gaps":
            section = section.withColumn("importance", F.when(F.col("importance") == "High", 1).when(F.col("importance") == "Med", 2).otherwise(3))
        text = lambda c: (F.lit(None) if c is None else F.col(c)).cast("string")
        values = [F.col(c).cast("double") for c in numbers] + [F.lit(None).cast("double")] * (3 - len(numbers))
        rows = section.select(F.lit(name).alias("section"), text(a).alias("a"), text(b).alias("b"), F.col(n).alias("listings"), *[v.alias(c) for v, c in zip(values, "xyz", strict=True)])
        out = rows if out is None else out.unionByName(rows)
    return out


@query("w1_scores", RUN + "SELECT k, profile_id, source, verification_status, salary_min, len(tags) AS n_tags, match_score, tier FROM tiered")
def w1_scores(spark, sf):
    """Tiered listings of the whole run: opening, profile, score and tier."""
    out, _ = whole_run(spark, sf)
    tags = out.listings.groupBy("place").agg(F.sum(F.size("tags")).alias("n_tags"))
    tiered = out.scored.filter("tier IS NOT NULL").join(tags, "place")
    return tiered.select(F.regexp_extract("url", r"(\d+)$", 1).cast("bigint").alias("k"), "profile_id", "source", "verification_status", "salary_min", "n_tags", "match_score", "tier")
