"""Predicates over listings and the keyword score."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.functions.text import blank_to_null, contains_any, count_found, lowered, searchable_text, terms_found
from vacancia.operators.order import rank_within

FRESH_DAYS, EXPIRED_DAYS = 60, 90


@dataclass(frozen=True)
class SearchConfig:
    """One candidate's search settings."""

    keywords: Sequence[str] = ()
    seniority: Sequence[str] = ()
    exclude_keywords: Sequence[str] = ()
    remote_only: bool = False
    min_score: float = 0.0

    @classmethod
    def from_text(cls, keywords="", seniority="", exclude_keywords="", **rest) -> "SearchConfig":
        """Settings given as comma lists; blank entries are dropped."""
        def split(s):
            return tuple(p.strip() for p in s.split(",") if p.strip())

        return cls(split(keywords), split(seniority), split(exclude_keywords), **rest)


def remote_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("remote"))


def seniority_in(df: DataFrame, levels: Sequence[str], fixed: bool = False) -> DataFrame:
    """Case-insensitive level test; no levels keeps all.

    `fixed=True` also accepts levels spelled by the source, such as "Senior Level".
    """
    if not levels:
        return df
    wanted = [level.lower() for level in levels]
    value = lowered("seniority")
    test = value.isin(*wanted)
    if fixed:
        test = test | F.arrays_overlap(F.split(value, r"\W+"), F.array(*[F.lit(w) for w in wanted]))
    return df.filter(test)


def not_excluded(title: Column | str, exclude: Sequence[str]) -> Column:
    """True unless an exclude keyword is a substring of the title."""
    return ~contains_any(lowered(title), [k.lower() for k in exclude]) if exclude else F.lit(True)


def exclude_titles(df: DataFrame, exclude: Sequence[str]) -> DataFrame:
    return df.filter(not_excluded("title", exclude))


def keyword_score(matched: Column, in_title: Column, total: Column) -> Column:
    """A title hit counts 3, a hit elsewhere 1, out of 3 per keyword; half-even at one decimal, 100 at most."""
    raw = (in_title * 3 + (matched - in_title)) / (total * 3).cast("double") * 100
    return F.least(F.bround(raw, 1), F.lit(100.0))


def score_keywords(df: DataFrame, keywords: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Add `preliminary_relevance_score` and `matched_keywords`.

    Without keywords every row gets 50 and excludes are not looked at. The keywords are literals of the
    plan, one compiled substring test each; `match.score_profiles` takes them from a column instead.
    """
    if not keywords:
        none = F.array().cast("array<string>")
        return df.select("*", F.lit(50.0).alias("preliminary_relevance_score"), none.alias("matched_keywords"))
    df = exclude_titles(df, exclude)
    # The title begins the searchable text, so a title hit is also a text hit.
    work = df.select("*", searchable_text().alias("_full"), lowered("title").alias("_title"))
    work = work.select("*", terms_found(F.col("_full"), keywords).alias("matched_keywords"), count_found(F.col("_title"), keywords).alias("_hits"))
    score = keyword_score(F.size("matched_keywords"), F.col("_hits"), F.lit(len(keywords)))
    return work.withColumn("preliminary_relevance_score", score).drop("_full", "_title", "_hits")


def filter_and_score(df: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Remote, seniority and title excludes first, then the score and its lower bound."""
    if cfg.remote_only:
        df = remote_only(df)
    df = seniority_in(df, cfg.seniority)
    df = score_keywords(df, cfg.keywords, cfg.exclude_keywords)
    return df.filter(F.col("preliminary_relevance_score") >= cfg.min_score)


def drop_expired(df: DataFrame, status: str = "status") -> DataFrame:
    return df.filter(F.coalesce(F.col(status), F.lit("")) != "EXPIRED")


def age_band(posted: Column | str, as_of: Column) -> Column:
    """fresh under 60 days, stale for 60 to 90, expired beyond, unknown without a date."""
    age = F.datediff(as_of, F.col(posted) if isinstance(posted, str) else posted)
    return (
        F.when(age.isNull(), "date unknown")
        .when(age < FRESH_DAYS, "fresh")
        .when(age <= EXPIRED_DAYS, "stale")
        .otherwise("expired")
    )


def drop_stale(df: DataFrame, as_of: Column) -> DataFrame:
    """Drop listings past 90 days, add `age_band` to the rest."""
    return df.withColumn("age_band", age_band("posted_date", as_of)).filter(F.col("age_band") != "expired")


def dealbreakers(df: DataFrame, work_modes: Sequence[str] = (), terms: Sequence[str] = ()) -> DataFrame:
    """Keep listings in an accepted work mode whose text has none of the terms."""
    if work_modes:
        df = df.filter(F.col("work_mode").isin(*work_modes))
    return df.filter(~contains_any(searchable_text(), [t.lower() for t in terms])) if terms else df


@dataclass(frozen=True)
class SourceQuery:
    """A source's own search parameters, applied to landed listings.

    `equal` compares whole fields, `tag` and `category` look into the list columns, `geo` and
    `location` are substrings of the location.
    """

    category: str | None = None
    tag: str | None = None
    geo: str | None = None
    level: str | None = None
    location: str | None = None
    equal: dict[str, str] = field(default_factory=dict)
    limit: int | None = None  # rows of each source on a page
    page: int = 0


def source_query(df: DataFrame, q: SourceQuery, *position: Column | str) -> DataFrame:
    """The listings a source would have sent; with a limit, `position` is the order its rows are counted in."""

    def has(column, value):
        return F.exists(column, lambda x: F.lower(x) == value.lower())

    if q.category:
        df = df.filter(has("departments", q.category))
    if q.tag:
        df = df.filter(has("tags", q.tag))
    if q.level:
        df = df.filter(lowered("seniority") == q.level.lower())
    for place in (q.geo, q.location):
        if place:
            df = df.filter(F.contains(lowered("location"), F.lit(place.lower())))
    for column, value in q.equal.items():
        df = df.filter(blank_to_null(column) == value)
    if q.limit is None:
        return df
    order = [F.col(p) if isinstance(p, str) else p for p in position]
    ranked = rank_within(df, ["source"], order, "_n", q.limit * (q.page + 1))
    return ranked.filter(F.col("_n") > q.limit * q.page).drop("_n")
