"""Inferred attributes: seniority, work mode, remote flag, dates, salaries, match keys."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacancia.functions.text import WS, blank_to_null, col, contains_any, filled_number, first_filled, lowered, strip_ws

# The level tests, in order; plain substrings of the lower-case title.
SENIORITY_TERMS = {
    "executive": ["chief", "cto", "ceo", "cfo", "coo", "c-suite", "vp ", "vice president"],
    "director": ["director", "head of", "head,", "principal"],
    "senior": ["senior", "sr.", "sr ", "lead", "staff", "manager"],
    "junior": ["junior", "jr.", "jr ", "entry", "associate", "intern", "graduate"],
}
DEFAULT_SENIORITY = "mid"
SENIORITY_ORDER = ["junior", "mid", "senior", "director", "executive"]

# Company suffixes, in the order they are taken off.
COMPANY_SUFFIXES = [
    " inc", " inc.", " llc", " ltd", " ltd.", " gmbh", " pty", " co.", " corp", " corporation", " limited",
]

# Duplicate preference of the source classes, lower wins.
SOURCE_PRIORITY = {
    "greenhouse": 1, "lever": 1, "workable": 1, "ashby": 1,
    "remotive": 2, "remoteok": 2, "jobicy": 2, "himalayas": 2, "themuse": 2,
    "rss": 3,
}
UNKNOWN_PRIORITY = 99


def infer_seniority(title: Column | str, fixed: bool = False) -> Column:
    """Ordered level tests. `fixed=True` asks for word boundaries instead of bare substrings."""
    # One pattern per level reads the title four times at most, where single tests would read it thirty times.
    t = lowered(title)
    out = None
    for level, terms in SENIORITY_TERMS.items():
        pattern = "|".join(re.escape(term.strip() if fixed else term) for term in terms)
        hit = F.rlike(t, F.lit(rf"(?<!\w)(?:{pattern})(?!\w)" if fixed else pattern))
        out = F.when(hit, level) if out is None else out.when(hit, level)
    return out.otherwise(DEFAULT_SENIORITY)


def infer_work_mode(location: Column | str, remote_flag: Column | None = None) -> Column:
    loc = lowered(location)
    remote = F.contains(loc, F.lit("remote"))
    mode = (
        F.when(remote & contains_any(loc, ["hybrid", "onsite", "office"]), "hybrid")
        .when(remote, "remote")
        .when(F.contains(loc, F.lit("hybrid")), "hybrid")
        .otherwise("onsite")
    )
    return mode if remote_flag is None else F.when(remote_flag, "remote").otherwise(mode)


def remote_from_text(*texts: Column | str, words: tuple[str, ...] = ("remote",)) -> Column:
    return contains_any(F.concat(*[lowered(t) for t in texts]), words)


def int_salary(text: Column) -> Column:
    """Whole-number salary of a JSON number or a digit string; anything else, or 0, is null."""
    return filled_number(F.expr("null").cast("bigint") if text is None else text.try_cast("bigint"))


def default_currency(amount_present: Column, currency: Column | None = None, default: str = "USD") -> Column:
    value = F.lit(default) if currency is None else F.coalesce(currency, F.lit(default))
    return F.when(amount_present, value)


def date_prefix(*cols: Column | str) -> Column:
    """First ten characters of the first filled field."""
    return F.substring(first_filled(*cols), 1, 10)


def typed_date(raw: Column | str) -> Column:
    """Date beside the raw text: ISO prefix, or RFC 822 with the weekday taken off."""
    full = strip_ws(F.coalesce(col(raw), F.lit("")))
    iso = F.try_to_date(F.regexp_extract(full, r"\A(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    rfc = F.regexp_extract(full, r"\A(?:[A-Za-z]{3}, *)?(\d{1,2} [A-Za-z]{3} \d{4})", 1)
    return F.coalesce(iso, F.try_to_date(rfc, "d MMM yyyy"))


def epoch_ms_date(ms: Column) -> Column:
    """yyyy-MM-dd of epoch milliseconds in the session time zone; "" for none or 0."""
    return F.coalesce(F.date_format(F.timestamp_millis(filled_number(ms)), "yyyy-MM-dd"), F.lit(""))


def company_key(name: Column | str) -> Column:
    """Company name for matching: lower case, suffixes off, letters, digits and spaces only.

    Every suffix is one word, so taking them off in list order removes a run of trailing words whose
    list positions fall from left to right. One anchored pattern, last suffix first, finds that run.
    """
    run = "".join(f"(?:{s.replace('.', chr(92) + '.')})?" for s in reversed(COMPANY_SUFFIXES))
    bare = F.regexp_replace(strip_ws(lowered(name)), rf"{run}\z", "")
    return strip_ws(F.regexp_replace(bare, r"(?U)[^a-z0-9\s\x1c-\x1f]", ""))


def title_key(title: Column | str) -> Column:
    """Title for matching: lower case, no parentheses, no work-mode words, single spaces."""
    t = F.regexp_replace(strip_ws(lowered(title)), r"\([^)]*\)", "")
    t = F.regexp_replace(t, r"(?Ud)\b(remote|hybrid|onsite|full.?time|part.?time|contract)\b", "")
    return strip_ws(F.regexp_replace(t, rf"(?U){WS}+", " "))


def source_priority(source: Column | str) -> Column:
    s = col(source)
    out = None
    for rank in sorted(set(SOURCE_PRIORITY.values())):
        hit = s.isin(*[name for name, r in SOURCE_PRIORITY.items() if r == rank])
        out = F.when(hit, rank) if out is None else out.when(hit, rank)
    return out.otherwise(UNKNOWN_PRIORITY)


def channel(source: Column | str) -> Column:
    """ats, api or rss."""
    p = source_priority(source)
    return F.when(p == 1, "ats").when(p == 2, "api").when(p == 3, "rss")


def backfill_company(company: Column | str, fallback: Column | str) -> Column:
    return F.coalesce(blank_to_null(company), blank_to_null(fallback), F.lit(""))
