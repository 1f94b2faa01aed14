"""Whole runs: board scan, feed scan, and the merge that leads to scores and a report.

The scans return lazy frames. The merge works on the way: deduplication, whose steps depend on one another,
and the two tables that every section reads.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.functions.text import lowered, searchable_text
from vacancia.operators import dedup, match, report, sinks, verify
from vacancia.operators.filters import SearchConfig, drop_stale, filter_and_score
from vacancia.schema import API_SOURCES, ATS_SOURCES, LISTING
from vacancia.session import materialize
from vacancia.sources import feeds, landing, mappings


@dataclass(frozen=True)
class Landing:
    """Folders (or files) of a landing zone; `feeds` and `boards` may be None where that channel was not run."""

    boards: str | None
    manifest: str | None
    feeds: str | None
    pages: str
    companies: str
    sector_keywords: str
    glob: str | None = None  # which files of boards and feeds are read; None for the usual endings


def scan_boards(spark: SparkSession, landing_path: str, manifest_path: str, cfg: SearchConfig, sources=ATS_SOURCES + API_SOURCES, glob: str = landing.PAYLOAD_SUFFIXES) -> DataFrame:
    """Landed board and search responses to scored listings, companies filled in from the manifest.

    Files and manifest are read once, into a folder for each source, so every mapping reads its own documents only.
    """
    manifest = landing.scan_manifest(spark, manifest_path)
    docs = materialize(landing.join_manifest(landing.scan_payloads(spark, landing_path, glob), manifest), "payloads", "source")
    docs = landing.parse_payloads(docs.withColumnRenamed("company", "fallback_company"))
    listings = mappings.normalize_all(docs, sources)
    named = mappings.with_company_fallback(listings)
    return filter_and_score(named, cfg)


def scan_feeds(spark: SparkSession, landing_path: str, cfg: SearchConfig, glob: str = feeds.FEED_FILES) -> DataFrame:
    """Landed RSS and Atom files to scored listings."""
    items = feeds.scan_feeds(spark, landing_path, glob)
    return filter_and_score(mappings.normalize(feeds.as_payloads(items), "rss"), cfg)


def _scored_columns(listings: DataFrame) -> DataFrame:
    """Listings that no keyword score was made for sort as if it were 0 and match no keyword."""
    missing = {"preliminary_relevance_score": F.lit(0.0), "matched_keywords": F.array().cast("array<string>")}
    return listings.withColumns({c: v for c, v in missing.items() if c not in listings.columns})


@dataclass(frozen=True)
class Matched:
    listings: DataFrame      # verified, dated survivors with merged tags, alternates and `place` in the final order; see dedup.nested on `chunk`
    duplicates: dedup.Deduplicated
    scored: DataFrame        # listing-profile pairs with scores, tiers and, where tiered, rank; tags and alternates are in `listings`
    sections: dict[str, DataFrame]


def merge_and_match(channels: list[DataFrame | None], position: list[Column | str], pages: DataFrame, profiles: DataFrame,
                    skills: list[str], as_of: Column, companies: DataFrame, sector_keywords: DataFrame) -> Matched:
    """Union, deduplicate, verify, drop the old, score against the profiles, rank, and count for the report.

    A listing has the sectors of the company of its name in `companies`; a profile's sector terms are those
    `sector_keywords` has for its sectors. Listings and scores are written once, as every section reads them:
    one row per survivor; of tags beyond a first chunk the text holds the terms that some profile asks for.
    """
    ran = [c for c in channels if c is not None]
    merged = report.union_channels(*ran) if ran else profiles.sparkSession.createDataFrame([], LISTING)
    deduplicated = dedup.deduplicate(merged, *position)
    chunks = materialize(dedup.array_chunks(deduplicated), "chunks")
    live = verify.merge_status(deduplicated.survivors.drop("tags", "alternate_sources"), verify.check_pages(pages))
    placed = dedup.final_position(drop_stale(_scored_columns(live), as_of))
    current = materialize(placed, "current")
    asking = materialize(match.with_sector_terms(profiles, sector_keywords), "asking")
    dictionary = match.skill_dictionary(profiles.sparkSession, skills)
    later = match.terms_in_later_tags(chunks, materialize(match.profile_terms(asking, [t.strip() for t in skills]), "terms"))
    first = chunks.filter("chunk = 0").select("leader", "tags")
    texts = materialize(current.join(first, "leader").select("leader", lowered("title").alias("title"), searchable_text().alias("full")), "texts")
    known = match.with_found_terms(match.with_company_sectors(current, companies), "leader", texts, asking, dictionary, later)
    pairs = match.every_pair(known, asking)
    points = materialize(match.match_score(match.meets_dealbreakers(pairs), as_of), "scored")
    ranks = match.rank_in_tier(points.select("profile_id", "tier", "match_score", "source", "place"), position="place")
    scored = points.join(ranks.select("profile_id", "place", "rank"), ["profile_id", "place"], "left")
    ranked = points.filter(F.col("tier").isNotNull())
    sections = report.pool_sections(current) | {
        "tiers": report.tier_counts(points),
        "gaps": report.skill_gaps(match.missing_skills(ranked, profiles)),
    }
    return Matched(current.join(chunks, "leader"), deduplicated, scored, sections)


def run(spark: SparkSession, landed: Landing, cfg: SearchConfig, profiles: DataFrame, skills: list[str], as_of: Column, report_path: str) -> Matched:
    """From landed files to a committed report: both scans, the merge, and every section written to `report_path`.

    Both channels are written before they are merged, as a run's result sets are; a channel that was not run
    (None) adds nothing. `sinks.read_report` reads the sections back.
    """
    usual = landed.glob is None
    channels: list[DataFrame | None] = []
    if landed.boards is not None:
        scanned = scan_boards(spark, landed.boards, landed.manifest, cfg, glob=landing.PAYLOAD_SUFFIXES if usual else landed.glob)
        channels.append(materialize(scanned, "boards-channel"))
    if landed.feeds is not None:
        channels.append(materialize(scan_feeds(spark, landed.feeds, cfg, feeds.FEED_FILES if usual else landed.glob), "feeds-channel"))
    out = merge_and_match(
        channels, ["source", "source_id"], landing.scan_pages(spark, landed.pages), profiles, skills, as_of,
        landing.scan_companies(spark, landed.companies), landing.scan_sector_keywords(spark, landed.sector_keywords))
    sinks.write_report(out.sections, report_path)
    sinks.commit_report(spark, list(out.sections), report_path)
    return out
