"""Companies, keywords and skills joined to candidate profiles; match score, tier and rank.

The six weights, the tiers and the 30-day rule are given; the formula inside each dimension is this
library's own choice and is stated at each function.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.functions.infer import SENIORITY_ORDER, company_key, source_priority
from vacancia.functions.text import lowered, searchable_text, terms_found
from vacancia.operators.containment import contained_terms
from vacancia.operators.filters import keyword_score
from vacancia.operators.order import rank_within
from vacancia.session import materialize

SKILLS, SENIORITY, SECTOR, WORK_MODE, VALUES, RECENCY = 30.0, 20.0, 20.0, 15.0, 10.0, 5.0
UNKNOWN_RECENCY = 3.0
FULL_RECENCY_DAYS, NO_RECENCY_DAYS = 30, 90
NEAR_LEVELS = 2  # `listing_profile_pairs` leaves out a level further from every target
UNKNOWN_LEVEL = "unknown"  # key of listings whose level is none of SENIORITY_ORDER
TIER_FLOORS = {1: 80.0, 2: 60.0, 3: 40.0}


def target_companies(companies: DataFrame, profiles: DataFrame) -> DataFrame:
    """(profile_id, company columns) where a sector of the company is one of the candidate's.

    Both sides are exploded to one row per sector, so the overlap is an equi-join.
    """
    wanted = profiles.select("profile_id", F.explode("sectors").alias("sector")).distinct()
    offered = companies.select("name", F.explode("sectors").alias("sector")).distinct()
    pairs = offered.join(wanted, "sector").select("profile_id", "name").distinct()
    return pairs.join(companies, "name")


def profile_keywords(profiles: DataFrame, sector_keywords: DataFrame) -> DataFrame:
    """(profile_id, keyword): the profile's own terms and those of its sectors, each once.

    A profile whose sectors have no keyword set keeps its own terms.
    """
    own = profiles.select("profile_id", F.explode(F.array_union("keywords", "skills")).alias("keyword"))
    sectors = profiles.select("profile_id", F.explode("sectors").alias("sector"))
    title_terms = sector_keywords.filter(F.col("kind") != "exclude").select("sector", "keyword")
    return own.unionByName(sectors.join(title_terms, "sector").select("profile_id", "keyword")).distinct()


def with_company_sectors(listings: DataFrame, companies: DataFrame) -> DataFrame:
    """Add `company_sectors`: the sectors of the companies whose name has the listing's company key."""
    known = companies.select(company_key("name").alias("_ck"), F.explode("sectors").alias("s")).filter("_ck <> ''")
    known = known.groupBy("_ck").agg(F.sort_array(F.collect_set("s")).alias("company_sectors"))
    joined = listings.withColumn("_own", company_key("company")).join(known, F.col("_own") == F.col("_ck"), "left")
    return joined.drop("_own", "_ck").withColumn("company_sectors", F.coalesce("company_sectors", F.array().cast("array<string>")))


def with_sector_terms(profiles: DataFrame, sector_keywords: DataFrame) -> DataFrame:
    """Add `sector_terms`: the title and description terms of a profile's sectors."""
    wanted = profiles.select("profile_id", F.explode("sectors").alias("sector"))
    terms = wanted.join(sector_keywords.filter(F.col("kind") != "exclude"), "sector")
    terms = terms.groupBy("profile_id").agg(F.sort_array(F.collect_set("keyword")).alias("sector_terms"))
    return profiles.join(terms, "profile_id", "left").withColumn("sector_terms", F.coalesce("sector_terms", F.array().cast("array<string>")))


def with_required_skills(listings: DataFrame, dictionary: Sequence[str]) -> DataFrame:
    """Add `search_text` and `required_skills`: dictionary skills that are substrings of the text, in dictionary order.

    The dictionary is a setting, like a search's keywords: it travels inside the plan, so no join is needed.
    Terms found in tags that are not in the row (`later_terms`) follow the text, behind NULs.
    """
    text = searchable_text()
    if "later_terms" in listings.columns:
        nul = F.lit("\u0000")
        text = F.when(F.col("later_terms").isNull(), text).otherwise(F.concat(text, nul, F.array_join("later_terms", "\u0000")))
    work = listings.withColumn("search_text", text).drop("later_terms")
    return work.withColumn("required_skills", terms_found(F.col("search_text"), dictionary))


def profile_terms(profiles: DataFrame, dictionary: Sequence[str]) -> DataFrame:
    """term: every lower-case term that scores and dealbreakers look for in a listing's text, each once."""
    own = [profiles.select(F.explode(c).alias("term")).select(F.lower("term").alias("term")) for c in ("sector_terms", "value_terms", "dealbreaker_terms")]
    out = profiles.sparkSession.createDataFrame([(t.lower(),) for t in dictionary], "term string")
    for terms in own:
        out = out.unionByName(terms)
    return out.filter("term <> ''").distinct()


def terms_in_later_tags(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """leader, later_terms: the terms found in tags of chunks above 0 (of `dedup.array_chunks`), chunk by chunk.

    A term spans one tag more than it has blanks at most, so each chunk is read with that many tags before it.
    """
    before = terms.agg(F.coalesce(F.max(F.regexp_count("term", F.lit(" "))), F.lit(0)).alias("n")).first()["n"]
    later = chunks.filter("chunk > 0 AND size(tags) > 0").select("leader", "chunk", "tags")
    ends = chunks.select("leader", (F.col("chunk") + 1).alias("chunk"), F.slice("tags", -F.least(F.size("tags"), F.lit(before)), before).alias("_end")) if before else None
    read = later.join(ends, ["leader", "chunk"]).withColumn("tags", F.concat("_end", "tags")) if before else later
    text = read.select("leader", F.lower(F.array_join("tags", " ")).alias("_text"))
    keyed = materialize(text.withColumn("_part", F.monotonically_increasing_id()), "later-texts")
    met = contained_terms(keyed, "_part", "_text", terms)
    found = met.join(keyed.select("_part", "leader"), "_part").select("leader", "term").distinct()
    return found.groupBy("leader").agg(F.sort_array(F.collect_list("term")).alias("later_terms"))


def skill_dictionary(spark: SparkSession, skills: Sequence[str]) -> DataFrame:
    """ord, skill, term (as it is looked for in a text) of the skills that are not blank."""
    rows = [(i, t, t.lower().strip()) for i, t in enumerate(skills) if t.strip()]
    return spark.createDataFrame(rows, "ord int, skill string, term string")


def _listed(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    return rows.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias(name))


def with_found_terms(listings: DataFrame, key: str, texts: DataFrame, profiles: DataFrame, dictionary: DataFrame, later: DataFrame | None = None) -> DataFrame:
    """Add `found_terms`, `title_terms` and `required_skills` (in dictionary order) to listings with a unique `key`.

    `texts` has key, `title` and `full`, both in lower case. The terms that profiles (with `sector_terms`) and
    `dictionary` (see `skill_dictionary`) ask for are looked for once per listing by the containment join,
    so pairs with profiles compare sets. `later` is key, later_terms of what the text does not hold.
    """
    asked = materialize(profile_terms(profiles, []).union(dictionary.select("term")).distinct(), "terms")
    found = contained_terms(texts, key, "full", asked)
    if later is not None:
        found = found.union(later.select(key, F.explode("later_terms")))
    found = materialize(found, "found-terms")
    sector = profiles.select(F.explode("sector_terms").alias("term")).select(F.lower("term").alias("term"))
    titles = contained_terms(texts, key, "title", sector)
    in_order = found.distinct().join(dictionary, "term").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ord", "skill"))).alias("_skills"))
    in_order = in_order.select(key, F.transform("_skills", lambda s: s["skill"]).alias("required_skills"))
    out = listings
    for part in (_listed(found, key, "term", "found_terms"), _listed(titles, key, "term", "title_terms"), in_order):
        out = out.join(part, key, "left")
    empty = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, empty) for c in ("found_terms", "title_terms", "required_skills")})


def _holds(found: str, text: Column, pairs: DataFrame):
    """Test of a term: whether it was found before the pairs were made (`with_found_terms`), else whether the text has it."""
    if found in pairs.columns:
        return lambda t: (F.lower(t) == "") | F.array_contains(F.col(found), F.lower(t))
    return lambda t: F.contains(text, F.lower(t))


def _text_of(pairs: DataFrame) -> Column:
    """The searchable text, taken over where it was made once per listing before the join."""
    if "found_terms" in pairs.columns:
        return F.lit(None).cast("string")  # the terms are known, the text is not looked at
    return F.col("search_text") if "search_text" in pairs.columns else searchable_text()


def listing_profile_pairs(listings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Listings with every profile that targets a level at most NEAR_LEVELS steps from theirs (`every_pair`: all).

    The level is the equi-join key; `seniority_points` grades the distance. Profiles are one row per level
    in reach; Spark broadcasts them only while they are under its size limit and otherwise shuffles, where
    a level held by most listings is split by the skew rule.
    """
    reach = F.flatten(F.transform("seniority_targets", _near_levels))
    by_level = profiles.withColumn("_level", F.explode(F.array_distinct(reach)))
    return listings.withColumn("_level", lowered("seniority")).join(by_level, "_level").drop("_level")


def every_pair(listings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every listing with every profile, whatever their levels; `seniority_points` gives 0 to far and unknown ones.

    Pairs meet in blocks: a listing's key is its level, or UNKNOWN_LEVEL (a level as the source spells it, or
    none), and a profile has one row for each key. As in `listing_profile_pairs`, profiles are broadcast only
    under Spark's size limit, else a level held by most listings is split by the skew rule.
    """
    own = lowered("seniority")
    keyed = listings.withColumn("_level", F.when(own.isin(*SENIORITY_ORDER), own).otherwise(UNKNOWN_LEVEL))
    keys = F.array(*[F.lit(k) for k in (*SENIORITY_ORDER, UNKNOWN_LEVEL)])
    return keyed.join(profiles.withColumn("_level", F.explode(keys)), "_level").drop("_level")


def score_profiles(pairs: DataFrame, keywords: Column | str = "keywords", exclude: Column | str = "exclude_keywords") -> DataFrame:
    """Keyword score of listing-profile pairs with the keywords held in a column; excluded titles drop out."""
    kw = F.col(keywords) if isinstance(keywords, str) else keywords
    ex = F.col(exclude) if isinstance(exclude, str) else exclude
    title = lowered("title")
    work = pairs.select("*", _text_of(pairs).alias("_full"), title.alias("_title"), kw.alias("_kw"), ex.alias("_ex"))
    has_kw = F.size("_kw") > 0
    work = work.filter(~has_kw | ~F.exists("_ex", lambda k: F.contains(F.col("_title"), F.lower(k))))
    matched = F.filter("_kw", lambda k: (F.trim(k) != "") & F.contains(F.col("_full"), F.lower(F.trim(k))))
    work = work.withColumn("matched_keywords", matched)
    hits = F.size(F.filter("matched_keywords", lambda k: F.contains(F.col("_title"), F.lower(F.trim(k)))))
    score = F.when(~has_kw, 50.0).otherwise(keyword_score(F.size("matched_keywords"), hits, F.greatest(F.size("_kw"), F.lit(1))))
    return work.withColumn("preliminary_relevance_score", score).drop("_full", "_title", "_kw", "_ex")


def meets_dealbreakers(pairs: DataFrame) -> DataFrame:
    """Pairs in an accepted work mode whose text has none of the profile's dealbreaker terms."""
    mode_ok = (F.size("work_modes") == 0) | F.array_contains("work_modes", F.col("work_mode"))
    return pairs.filter(mode_ok).withColumn("_full", _text_of(pairs)).filter(
        ~F.exists("dealbreaker_terms", _holds("found_terms", F.col("_full"), pairs))
    ).drop("_full")


def skills_points(required: Column, held: Column) -> Column:
    """Share of required skills held; half the points when none is stated."""
    return F.when(F.size(required) == 0, SKILLS / 2).otherwise(
        F.lit(SKILLS) * F.size(F.array_intersect(required, held)) / F.greatest(F.size(required), F.lit(1))
    )


def _level(c: Column) -> Column:
    levels = F.array(*[F.lit(s) for s in SENIORITY_ORDER])
    return F.nullif(F.array_position(levels, F.lower(c)), F.lit(0))


def _near_levels(target: Column) -> Column:
    """Levels at most NEAR_LEVELS steps from a target; an unknown target is only near itself."""
    levels = F.array(*[F.lit(s) for s in SENIORITY_ORDER])
    first = F.greatest(_level(target) - NEAR_LEVELS, F.lit(1))
    near = F.slice(levels, first.cast("int"), (_level(target) + NEAR_LEVELS - first + 1).cast("int"))
    return F.coalesce(near, F.array(F.lower(target)))


def seniority_points(seniority: Column, targets: Column) -> Column:
    """Ten points off per step to the nearest target level; an unknown level is worth nothing."""
    own = _level(seniority)
    nearest = F.array_min(F.transform(targets, lambda t: F.abs(_level(t) - own)))
    return F.coalesce(F.greatest(F.lit(0.0), SENIORITY - 10.0 * nearest), F.lit(0.0))


def sector_points(in_title, in_text, sector_terms: Column, sectors: Column, company_sectors: Column) -> Column:
    """All points for a sector term in the title or a shared company sector, half for one in the text."""
    shared = F.coalesce(F.arrays_overlap(sectors, company_sectors), F.lit(False))
    return F.when(F.exists(sector_terms, in_title) | shared, SECTOR).when(F.exists(sector_terms, in_text), SECTOR / 2).otherwise(0.0)


def work_mode_points(mode: Column, preferred: Column) -> Column:
    """All points for a preferred mode (or no preference), half when one of the two is hybrid."""
    near = (mode == "hybrid") | F.array_contains(preferred, F.lit("hybrid"))
    return (
        F.when((F.size(preferred) == 0) | F.array_contains(preferred, mode), WORK_MODE)
        .when(near, WORK_MODE / 2)
        .otherwise(0.0)
    )


def values_points(in_text, terms: Column) -> Column:
    """Share of the profile's value terms found in the text."""
    hits = F.size(F.filter(terms, in_text))
    return F.when(F.size(terms) == 0, 0.0).otherwise(F.lit(VALUES) * hits / F.greatest(F.size(terms), F.lit(1)))


def recency_points(posted: Column, as_of: Column) -> Column:
    """Full for 30 days, then linear to nothing at 90; three points without a date."""
    age = F.datediff(as_of, posted)
    fading = F.lit(RECENCY) * (NO_RECENCY_DAYS - age) / (NO_RECENCY_DAYS - FULL_RECENCY_DAYS)
    return (
        F.when(age.isNull(), UNKNOWN_RECENCY)
        .when(age <= FULL_RECENCY_DAYS, RECENCY)
        .otherwise(F.greatest(F.lit(0.0), fading))
    )


DIMENSIONS = ("skills", "seniority", "sector", "work_mode", "values", "recency")


def match_score(pairs: DataFrame, as_of: Column) -> DataFrame:
    """Add the six dimension columns `score_*`, `match_score` and `tier` to listing-profile pairs.

    Pairs carry the profile columns, plus `sector_terms`, `company_sectors` and `required_skills`.
    """
    work = pairs.select("*", lowered("title").alias("_title"), _text_of(pairs).alias("_full"))
    in_title, in_text = _holds("title_terms", F.col("_title"), pairs), _holds("found_terms", F.col("_full"), pairs)
    work = work.select(
        "*",
        skills_points(F.col("required_skills"), F.col("skills")).alias("score_skills"),
        seniority_points(F.col("seniority"), F.col("seniority_targets")).alias("score_seniority"),
        sector_points(in_title, in_text, F.col("sector_terms"), F.col("sectors"), F.col("company_sectors")).alias("score_sector"),
        work_mode_points(F.col("work_mode"), F.col("work_modes")).alias("score_work_mode"),
        values_points(in_text, F.col("value_terms")).alias("score_values"),
        recency_points(F.col("posted_date"), as_of).alias("score_recency"),
    ).drop("_title", "_full")
    total = sum((F.col(f"score_{d}") for d in DIMENSIONS[1:]), F.col("score_skills"))
    return work.withColumn("match_score", F.bround(total, 1)).withColumn("tier", tier(F.col("match_score")))


def tier(score: Column) -> Column:
    """1 from 80, 2 from 60, 3 from 40, else null; no gaps between the bands."""
    out = None
    for t, floor in TIER_FLOORS.items():
        out = F.when(score >= floor, t) if out is None else out.when(score >= floor, t)
    return out


def rank_in_tier(scored: DataFrame, top: int | None = None, position: str = "ord") -> DataFrame:
    """`rank` inside profile and tier by score, then source priority, then position."""
    tiered = scored.filter(F.col("tier").isNotNull()).withColumn("_priority", source_priority("source"))
    order = [F.desc("match_score"), F.asc("_priority"), F.asc(position)]
    return rank_within(tiered, ["profile_id", "tier"], order, "rank", top).drop("_priority")


def _required(pairs: DataFrame) -> DataFrame:
    return pairs.select("profile_id", "id", F.explode("required_skills").alias("skill"))


def _held(profiles: DataFrame) -> DataFrame:
    return profiles.select("profile_id", F.explode("skills").alias("skill")).distinct()


def covered_skills(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """(profile_id, id, skill) required by a listing and held by the candidate."""
    return _required(pairs).join(_held(profiles), ["profile_id", "skill"], "left_semi")


def missing_skills(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """(profile_id, id, skill) required by a listing and not held by the candidate."""
    return _required(pairs).join(_held(profiles), ["profile_id", "skill"], "left_anti")
