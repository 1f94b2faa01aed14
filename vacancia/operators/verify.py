"""Liveness of listing pages over a table of fetched pages, and the merge of its outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.functions.text import blank_to_null, contains_any, first_phrase, lowered

# Notices of a closed listing, in the order they are tried.
EXPIRED_PHRASES = [
    "no longer available",
    "no longer accepting",
    "position has been filled",
    "position filled",
    "this job has been closed",
    "this job is closed",
    "this role has been filled",
    "this posting has expired",
    "this listing has expired",
    "applications are closed",
    "applications are no longer being accepted",
    "this job has expired",
    "this opportunity is closed",
    "this position is no longer available",
    "job not found",
    "the position you are looking for is no longer",
    "this role is no longer open",
]
# Boards whose listed openings are open by definition.
BOARD_HOSTS = ["boards.greenhouse.io", "jobs.ashbyhq.com"]
SMALL_POOL = 10


def status_class(http_code: Column | str, variant: str = "shell") -> Column:
    """EXPIRED, UNVERIFIABLE or null (look at the page)."""
    c = F.col(http_code) if isinstance(http_code, str) else http_code
    gone = F.when(c.isin(404, 410), "EXPIRED")
    if variant == "shell":
        return gone.when(c.isNull() | ~c.isin(200, 301, 302), "UNVERIFIABLE")
    return gone.when(c.isNull() | (c == 0) | (c >= 400), "UNVERIFIABLE")


def is_generic_page(url: Column | str, variant: str = "shell") -> Column:
    """Does the address lead to a careers overview instead of one listing?

    shell: ends with /careers, /jobs or /openings. js: that is the whole path, /positions too.
    """
    u = F.col(url) if isinstance(url, str) else url
    if variant == "shell":
        return F.rlike(u, F.lit(r"/(careers|jobs|openings)/?$"))
    path = F.lower(F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit("")))
    return F.rlike(path, F.lit(r"\A/(careers|jobs|openings|positions)/?\z"))


def expired_phrase(body: Column | str) -> Column:
    return first_phrase(lowered(body), EXPIRED_PHRASES)


def is_board_url(url: Column | str) -> Column:
    return contains_any(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), BOARD_HOSTS)


def check_pages(pages: DataFrame, variant: str = "shell") -> DataFrame:
    """url, status, http_code, reason for every fetched page; one pass, no shuffle."""
    if variant not in ("shell", "js"):
        raise ValueError(f"unknown variant {variant!r}")
    code = F.col("http_code")
    body = F.coalesce("body", F.lit(""))
    work = pages.select(
        "url", "http_code", "final_url", body.alias("body"),
        status_class(code, variant).alias("by_code"), expired_phrase(body).alias("phrase"),
    )
    moved = (F.coalesce("final_url", F.lit("")) != "") & (F.col("final_url") != F.col("url")) & is_generic_page("final_url", variant)
    empty = (F.col("body") == "") if variant == "shell" else F.lit(False)
    status = (
        F.when(F.col("by_code").isNotNull(), F.col("by_code"))
        .when(empty, "UNVERIFIABLE")
        .when(F.col("phrase").isNotNull() | moved, "EXPIRED")
        .otherwise("VERIFIED")
    )
    quoted = F.col("phrase") if variant == "shell" else F.concat(F.lit('"'), F.col("phrase"), F.lit('"'))
    failed = (
        F.when(code.isNull() | code.isin(0, 403), "Connection failed or access denied").otherwise("Unexpected HTTP status")
        if variant == "shell"
        else F.when(code == 403, "Access denied").otherwise(F.concat(F.lit("HTTP "), code.cast("string")))
    )
    page_word = "careers page" if variant == "shell" else "page"
    reason = (
        F.when(F.col("by_code") == "EXPIRED", F.concat(F.lit("HTTP "), code.cast("string"), F.lit(" response")))
        .when(F.col("by_code") == "UNVERIFIABLE", failed)
        .when(empty, "Empty response body")
        .when(F.col("phrase").isNotNull(), F.concat(F.lit("Page contains: "), quoted))
        .when(moved, F.concat(F.lit(f"Redirected to generic {page_word}: "), F.col("final_url")))
        .otherwise("Page loads with no expired indicators")
    )
    return work.select("url", status.alias("status"), code.alias("http_code"), reason.alias("reason"))


def join_checks(listings: DataFrame, checks: DataFrame) -> DataFrame:
    """Listings with the check of their address, in one pass; board listings and blank addresses meet no check.

    Those get a key of their own in place of the address, so that they are dealt out evenly. One check per
    address: several checks of one address count as the worst of them.
    """
    severity = F.when(F.col("status") == "EXPIRED", 0).when(F.col("status") == "UNVERIFIABLE", 1).otherwise(2)
    per_url = checks.filter(blank_to_null("url").isNotNull()).groupBy(F.col("url").alias("_url")).agg(
        F.min_by("status", severity).alias("check_status"), F.min_by("reason", severity).alias("check_reason")
    )
    unchecked = F.coalesce(F.col("verification_status") == "GUARANTEED", F.lit(False)) | blank_to_null("url").isNull()
    own = F.concat(F.lit("\u0000"), F.xxhash64("source", "source_id", "title").cast("string"))
    keyed = listings.withColumn("_key", F.when(unchecked, own).otherwise(F.col("url")))
    return keyed.join(per_url, F.col("_key") == F.col("_url"), "left").drop("_key", "_url")


def merge_status(listings: DataFrame, checks: DataFrame) -> DataFrame:
    """Take over VERIFIED and UNVERIFIABLE, drop EXPIRED, leave GUARANTEED and unchecked rows as they are."""
    joined = join_checks(listings, checks).filter(F.coalesce("check_status", F.lit("")) != "EXPIRED")
    return joined.withColumn("verification_status", F.coalesce("check_status", "verification_status")).drop("check_status", "check_reason")


def search_status(url: Column | str, enriched: Column) -> Column:
    """Status of a search hit: board address, page read in full, or snippet only."""
    return F.when(is_board_url(url), "GUARANTEED").when(enriched, "VERIFIED").otherwise("UNVERIFIED")


def pool_notice(df: DataFrame) -> DataFrame:
    """pool_size and whether it is small enough to say so in the report."""
    size = F.coalesce(F.sum("_n"), F.lit(0).cast("bigint")) if "_n" in df.columns else F.count("*")  # counted by report.pool_facts
    return df.agg(size.alias("pool_size"), (size < SMALL_POOL).alias("small_pool"))
