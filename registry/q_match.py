"""Match scores of every listing against every profile that targets a level near its own."""

from pyspark.sql import functions as F

from registry.base import query
from registry.sql import FULL_TEXT, PART_LISTINGS, PROFILES, priority, with_tables
from registry.tables import ADJECTIVES, NOUNS, part_listings, profiles
from vacancia.operators import match
from vacancia.session import materialize

AS_OF = "2024-04-01"
_LEVELS = "['junior','mid','senior','director','executive']"
_AGE = f"date_diff('day', posted_date, DATE '{AS_OF}')"
_NEAR = f"len(list_filter(p.seniority_targets, lambda t: abs(list_position({_LEVELS}, t) - list_position({_LEVELS}, l.seniority)) <= 2)) > 0"
_SENIORITY = f"greatest(0::DOUBLE, 20 - 10::DOUBLE * list_min(list_transform(seniority_targets, lambda t: abs(list_position({_LEVELS}, t) - list_position({_LEVELS}, seniority)))))"
SCORED = with_tables(PART_LISTINGS, PROFILES) + f""", pairs AS (
  SELECT l.*, p.*, {FULL_TEXT} AS full_text,
    list_filter({ADJECTIVES + NOUNS}, lambda k: contains({FULL_TEXT}, k)) AS required
  FROM listings l JOIN profiles p ON {_NEAR}),
points AS (
  SELECT *,
    CASE WHEN len(required) = 0 THEN 15 ELSE 30::DOUBLE * len(list_intersect(required, skills)) / len(required) END AS score_skills,
    {_SENIORITY} AS score_seniority,
    CASE WHEN len(list_filter(sectors, lambda s: contains(lower(title), s))) > 0 OR list_contains(sectors, lower(p_type)) THEN 20
      WHEN len(list_filter(sectors, lambda s: contains(full_text, s))) > 0 THEN 10 ELSE 0 END::DOUBLE AS score_sector,
    CASE WHEN list_contains(work_modes, work_mode) THEN 15 WHEN work_mode = 'hybrid' OR list_contains(work_modes, 'hybrid') THEN 7.5 ELSE 0 END::DOUBLE AS score_work_mode,
    10::DOUBLE * len(list_filter(value_terms, lambda s: contains(full_text, s))) / len(value_terms) AS score_values,
    CASE WHEN posted_date IS NULL THEN 3 WHEN {_AGE} <= 30 THEN 5 ELSE greatest(0, 5::DOUBLE * (90 - {_AGE}) / 60) END::DOUBLE AS score_recency
  FROM pairs),
scored AS (SELECT *, round_even(score_skills + score_seniority + score_sector + score_work_mode + score_values + score_recency, 1) AS match_score FROM points),
tiered AS (SELECT *, CASE WHEN match_score >= 80 THEN 1 WHEN match_score >= 60 THEN 2 WHEN match_score >= 40 THEN 3 END AS tier FROM scored)
"""


def pairs(spark, sf):
    listings = match.with_required_skills(part_listings(spark, sf), ADJECTIVES + NOUNS)
    return _with_sectors(match.listing_profile_pairs(listings, profiles(spark, sf)))


def _with_sectors(joined):
    own_sector = F.transform("departments", lambda d: F.lower(d))
    return joined.withColumn("sector_terms", F.col("sectors")).withColumn("company_sectors", own_sector)


_RAW = "CASE source WHEN 'himalayas' THEN 'Senior Level' WHEN 'themuse' THEN 'Entry Level' ELSE seniority END"
EVERY = (
    SCORED.replace("FROM listings l JOIN profiles p ON " + _NEAR, f"FROM (SELECT * REPLACE ({_RAW} AS seniority) FROM listings) l CROSS JOIN profiles p")
    .replace(_SENIORITY, f"coalesce({_SENIORITY}, 0)")
)


@query("r8_every_listing", EVERY + "SELECT pos, profile_id, seniority, score_seniority, match_score, tier FROM tiered")
def r8_every(spark, sf):
    """Every listing against every profile; two sources spell their levels themselves."""
    raw = F.when(F.col("source") == "himalayas", "Senior Level").when(F.col("source") == "themuse", "Entry Level").otherwise(F.col("seniority"))
    listings = match.with_required_skills(part_listings(spark, sf).withColumn("seniority", raw), ADJECTIVES + NOUNS)
    points = match.match_score(_with_sectors(match.every_pair(listings, profiles(spark, sf))), F.lit(AS_OF).cast("date"))
    return points.select("pos", "profile_id", "seniority", "score_seniority", "match_score", "tier")


def scored(spark, sf):
    return match.match_score(pairs(spark, sf), F.lit(AS_OF).cast("date"))


@query("j8_listing_profiles", SCORED + "SELECT pos, profile_id, array_to_string(required, '|') AS required FROM pairs")
def j8(spark, sf):
    return pairs(spark, sf).select("pos", "profile_id", F.array_join("required_skills", "|").alias("required"))


@query("j8_profile_keywords", SCORED + """
SELECT pos, profile_id, array_to_string(hits, '|') AS matched, round_even((3 * t + len(hits) - t) / (3.0 * len(keywords))::DOUBLE * 100, 1) AS score
FROM (SELECT *, list_filter(keywords, lambda k: contains(full_text, k)) AS hits, len(list_filter(keywords, lambda k: contains(lower(title), k))) AS t FROM pairs)
WHERE NOT contains(lower(title), exclude_keywords[1])""")
def j8_keywords(spark, sf):
    return match.score_profiles(pairs(spark, sf)).select(
        "pos", "profile_id", F.array_join("matched_keywords", "|").alias("matched"), F.col("preliminary_relevance_score").alias("score"))


@query("f8_profile_dealbreakers", SCORED + """
SELECT pos, profile_id FROM pairs WHERE list_contains(work_modes, work_mode) AND NOT contains(full_text, dealbreaker_terms[1])""")
def f8_profiles(spark, sf):
    return match.meets_dealbreakers(pairs(spark, sf)).select("pos", "profile_id")


_REQUIRED = "SELECT profile_id, id, unnest(required) AS skill, skills FROM tiered WHERE tier IS NOT NULL"


@query("j9_covered_skills", SCORED + f"SELECT profile_id, id, skill FROM ({_REQUIRED}) WHERE list_contains(skills, skill)")
def j9_covered(spark, sf):
    return match.covered_skills(scored(spark, sf).filter("tier IS NOT NULL"), profiles(spark, sf))


@query("j9_missing_skills", SCORED + f"SELECT profile_id, id, skill FROM ({_REQUIRED}) WHERE NOT list_contains(skills, skill)")
def j9_missing(spark, sf):
    return match.missing_skills(scored(spark, sf).filter("tier IS NOT NULL"), profiles(spark, sf))


def _points(name):
    def run(spark, sf):
        return scored(spark, sf).select("pos", "profile_id", f"score_{name}")

    run.__name__ = f"points_{name}"
    return run


for _i, _name in enumerate(match.DIMENSIONS, start=1):
    query(f"r{_i}_{_name}_points", SCORED + f"SELECT pos, profile_id, score_{_name} FROM scored")(_points(_name))


@query("r7_match_score", SCORED + "SELECT pos, profile_id, match_score FROM scored")
def r7(spark, sf):
    return scored(spark, sf).select("pos", "profile_id", "match_score")


@query("r8_tier", SCORED + "SELECT pos, profile_id, match_score, tier FROM tiered")
def r8(spark, sf):
    return scored(spark, sf).select("pos", "profile_id", "match_score", "tier")


@query("r9_rank_in_tier", SCORED + f"""
SELECT pos, profile_id, tier, match_score, row_number() OVER (PARTITION BY profile_id, tier ORDER BY match_score DESC, {priority()}, pos) AS rank FROM tiered WHERE tier IS NOT NULL""")
def r9(spark, sf):
    keys = scored(spark, sf).filter("tier IS NOT NULL").select("pos", "profile_id", "tier", "match_score", "source")
    # Written first: the range sort reads its input twice, to find the bounds and to sort.
    return match.rank_in_tier(materialize(keys, "tiered"), position="pos").select("pos", "profile_id", "tier", "match_score", "rank")


@query("r9_top_in_tier", SCORED + f"""
SELECT pos, profile_id, tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, tier ORDER BY match_score DESC, {priority()}, pos) AS rank FROM tiered WHERE tier IS NOT NULL) WHERE rank <= 10""")
def r9_top(spark, sf):
    return match.rank_in_tier(scored(spark, sf), top=10, position="pos").select("pos", "profile_id", "tier", "rank")
