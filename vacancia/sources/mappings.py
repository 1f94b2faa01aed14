"""The ten source mappings: one payload document to unified listings, as column expressions over VARIANT.

Missing, null and wrongly typed fields give empty values; a null nested object costs nothing but its own
fields. Each mapping takes a frame with `v` (the parsed document) and returns `schema.LISTING` columns
plus whatever else the frame carried.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.functions.html import strip_html, strip_html_list
from vacancia.functions.infer import (
    backfill_company,
    default_currency,
    epoch_ms_date,
    filled_number,
    infer_seniority,
    infer_work_mode,
    remote_from_text,
    typed_date,
)
from vacancia.functions.text import blank_to_null, drop_blanks, first_filled, make_id, singleton
from vacancia.schema import SOURCES, conform

REMOTE = "Remote"
# Fixed value: where an opening without an address of its own is shown.
HIMALAYAS_PAGE = "https://himalayas.app/jobs/"


def _get(path: str, kind: str = "string", v: Column | None = None) -> Column:
    return F.try_variant_get(F.col("j") if v is None else v, f"$.{path}" if path else "$", kind)


def _is_object(path: str, v: Column | None = None) -> Column:
    return _get(path, "map<string,variant>", v).isNotNull()


def _is_list(path: str) -> Column:
    return _get(path, "array<variant>").isNotNull()


def _str(*paths: str, default: str = "") -> Column:
    """First filled of several fields as text."""
    return first_filled(*[_get(p) for p in paths], default=default)


def _id(*paths: str) -> Column:
    """First filled of several id fields as text; the number 0 and false count as empty, the text "0" does not."""
    def filled(p):
        return F.when(~F.coalesce(F.to_json(_get(p, "variant")).isin("0", "0.0", "false"), F.lit(False)), _get(p))

    return first_filled(*[filled(p) for p in paths])


def _flag(path: str) -> Column:
    return F.coalesce(_get(path, "boolean"), F.lit(False))


def _text_list(path: str) -> Column:
    return F.coalesce(_get(path, "array<string>"), F.array().cast("array<string>"))


def _names(path: str) -> Column:
    """`name` of the objects in a list; other elements are skipped."""
    items = F.filter(F.coalesce(_get(path, "array<variant>"), F.expr("cast(array() as array<variant>)")), lambda x: _is_object("", x))
    return F.transform(items, lambda x: F.coalesce(_get("name", v=x), F.lit("")))


def _name_or_text(path: str) -> Column:
    """A field that is either text or an object with a name."""
    return F.when(_is_object(path), F.coalesce(_get(f"{path}.name"), F.lit(""))).otherwise(_str(path))


def _amount(*paths: str) -> Column:
    """First field that holds a whole number other than 0."""
    return F.coalesce(*[filled_number(_get(p, "bigint")) for p in paths])


def _explode(df: DataFrame, root: str | None, positions: bool = False) -> DataFrame:
    """One row per listing `j`: the list under `root`, or the document itself when it is a list."""
    whole = F.try_variant_get("v", "$", "array<variant>")
    items = whole if root is None else F.coalesce(F.try_variant_get("v", f"$.{root}", "array<variant>"), whole)
    keep = [c for c in df.columns if c not in ("v", "raw")]
    if positions:
        out = df.select(*keep, F.size(items).alias("_n"), F.posexplode(items).alias("_pos", "j"))
    else:
        out = df.select(*keep, F.explode(items).alias("j"))
    return out.filter(_is_object("", F.col("j")))


def _skip_first(df: DataFrame) -> DataFrame:
    """The first of several elements describes the service, not a listing."""
    return _explode(df, None, positions=True).filter((F.col("_pos") > 0) | (F.col("_n") == 1)).drop("_pos", "_n")


# How the documents of each source hold their listings.
ITEMS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "lever": lambda df: _explode(df, None),
    "remoteok": _skip_first,
    "themuse": lambda df: _explode(df, "results"),
    "rss": lambda df: _explode(df, "items"),
    **{s: lambda df: _explode(df, "jobs") for s in ("greenhouse", "workable", "ashby", "remotive", "jobicy", "himalayas")},
}


def _listing(df: DataFrame, source: str, *, key: tuple[str, ...], source_id: Column | None = None, title: Column, company: Column,
             location: Column, posted: Column, description: Column, url: Column, apply_url: Column | None = None,
             remote: Column | None = None, work_mode: Column | None = None, employment_type: Column | None = None,
             seniority: Column | None = None, salary_min: Column | None = None, salary_max: Column | None = None,
             currency: Column | None = None, departments: Column | None = None, tags: Column | None = None,
             status: str) -> DataFrame:
    """Shared part of the mappings; what is left out is inferred or empty."""
    empty = F.array().cast("array<string>")
    nothing = F.lit(None)
    keep = [c for c in df.columns if c not in ("j", "source")]
    # `key` names the fields of the id; a number 0 is no id but still shown as `source_id`.
    work = df.select(
        *keep, "j", _id(*key).alias("_key"), (_str(*key) if source_id is None else source_id).alias("source_id"),
        title.alias("title"), company.alias("company"), location.alias("location"), posted.alias("_posted"),
        description.alias("description_text"), url.alias("url"),
    )
    return conform(work.select(
        *keep,
        make_id(source, F.col("_key")).alias("id"),
        F.lit(source).alias("source"),
        "source_id", "title", "company", "location",
        (remote_from_text("location") if remote is None else remote).alias("remote"),
        (infer_work_mode("location") if work_mode is None else work_mode).alias("work_mode"),
        (F.lit("") if employment_type is None else employment_type).alias("employment_type"),
        (infer_seniority("title") if seniority is None else seniority).alias("seniority"),
        (nothing if salary_min is None else salary_min).alias("salary_min"),
        (nothing if salary_max is None else salary_max).alias("salary_max"),
        (nothing if currency is None else currency).alias("salary_currency"),
        F.substring("_posted", 1, 10).alias("posted_date_raw"),
        typed_date("_posted").alias("posted_date"),
        "description_text", "url",
        (F.col("url") if apply_url is None else apply_url).alias("apply_url"),
        (empty if departments is None else departments).alias("departments"),
        (empty if tags is None else tags).alias("tags"),
        F.lit(status).alias("verification_status"),
    ))


def greenhouse(df: DataFrame) -> DataFrame:
    return _listing(
        ITEMS["greenhouse"](df), "greenhouse", status="GUARANTEED",
        key=("id",), title=_str("title"), company=_str("company_name", "board_name"),
        location=_str("location.name"), posted=_str("updated_at", "first_published_at"),
        description=strip_html(_get("content")), url=_str("absolute_url"), departments=_names("departments"),
    )


def lever(df: DataFrame) -> DataFrame:
    lists = F.coalesce(_get("lists", "array<variant>"), F.expr("cast(array() as array<variant>)"))
    headings = F.transform(lists, lambda x: F.coalesce(_get("text", v=x), F.lit("")))
    bodies = strip_html_list(F.transform(lists, lambda x: _get("content", v=x)))
    sections = F.flatten(F.transform(F.arrays_zip(headings.alias("h"), bodies.alias("b")), lambda p: F.array(p["h"], p["b"])))
    lead = F.coalesce(blank_to_null(_get("descriptionPlain")), strip_html(_get("description")))
    description = F.when(F.size(lists) > 0, F.concat(lead, F.lit("\n"), F.array_join(sections, "\n"))).otherwise(lead)
    return _listing(
        ITEMS["lever"](df), "lever", status="GUARANTEED",
        key=("id",), title=_str("text"), company=_str("company"), location=_str("categories.location"),
        posted=epoch_ms_date(_get("createdAt", "bigint")), description=description,
        url=_str("hostedUrl", "applyUrl"), apply_url=_str("applyUrl", "hostedUrl"),
        employment_type=_str("categories.commitment"),
        departments=drop_blanks(F.array(_get("categories.department"), _get("categories.team"))),
        tags=F.array(_str("categories.allLocations")),
    )


def workable(df: DataFrame) -> DataFrame:
    location = F.concat_ws(", ", blank_to_null(_str("location", "city")), blank_to_null(_get("country")))
    remote_flag = _flag("telecommuting")
    return _listing(
        ITEMS["workable"](df), "workable", status="GUARANTEED",
        key=("shortcode", "id"), title=_str("title"), company=_str("company"), location=location,
        posted=_str("published_on", "created_at"), description=strip_html(_get("description")),
        url=_str("url", "application_url"), apply_url=_str("application_url", "url"),
        remote=remote_flag | remote_from_text("location"), work_mode=infer_work_mode("location", remote_flag),
        employment_type=_str("employment_type"), departments=singleton(_get("department")),
    )


def ashby(df: DataFrame) -> DataFrame:
    remote_flag = _flag("isRemote")
    tags = F.transform(
        F.coalesce(_get("tags", "array<variant>"), F.expr("cast(array() as array<variant>)")),
        lambda t: F.when(_is_object("", t), F.coalesce(_get("name", v=t), F.lit(""))).otherwise(F.coalesce(_get("", v=t), F.lit(""))),
    )
    return _listing(
        ITEMS["ashby"](df), "ashby", status="GUARANTEED",
        key=("id",), title=_str("title"), company=_str("organizationName"), location=_name_or_text("location"),
        posted=_str("publishedDate", "updatedAt"), description=strip_html(_str("descriptionHtml", "description")),
        url=_str("jobUrl", "applyUrl"), apply_url=_str("applyUrl", "jobUrl"),
        remote=remote_flag | remote_from_text("location"), work_mode=infer_work_mode("location", remote_flag),
        employment_type=_str("employmentType"),
        salary_min=_get("compensation.range.min", "double"), salary_max=_get("compensation.range.max", "double"),
        currency=_get("compensation.currency"), departments=singleton(_name_or_text("department")), tags=tags,
    )


def _remote_board(df: DataFrame, source: str, **columns) -> DataFrame:
    """Boards that list remote work only."""
    return _listing(df, source, status="API_ACTIVE", remote=F.lit(True), work_mode=F.lit("remote"), **columns)


def remotive(df: DataFrame) -> DataFrame:
    return _remote_board(
        ITEMS["remotive"](df), "remotive",
        key=("id",), title=_str("title"), company=_str("company_name"),
        location=_str("candidate_required_location", default=REMOTE), posted=_str("publication_date"),
        description=strip_html(_get("description")), url=_str("url"), employment_type=_str("job_type"),
        departments=singleton(_get("category")), tags=_text_list("tags"),
    )


def remoteok(df: DataFrame) -> DataFrame:
    low = _amount("salary_min")
    return _remote_board(
        ITEMS["remoteok"](df), "remoteok",
        key=("id",), title=_str("position"), company=_str("company"), location=_str("location", default=REMOTE),
        posted=_str("date"), description=strip_html(_get("description")), url=_str("url"), apply_url=_str("apply_url", "url"),
        salary_min=low, salary_max=_amount("salary_max"), currency=default_currency(low.isNotNull()), tags=_text_list("tags"),
    )


def jobicy(df: DataFrame) -> DataFrame:
    low = _amount("salaryMin", "annualSalaryMin", "salary_min")
    high = _amount("salaryMax", "annualSalaryMax", "salary_max")
    # A currency that is stated as null stays null; only a missing one gets the default.
    stated = default_currency(low.isNotNull() | high.isNotNull(), _get("salaryCurrency"))
    industry = F.when(_is_list("jobIndustry"), _text_list("jobIndustry")).otherwise(singleton(_get("jobIndustry")))
    return _remote_board(
        ITEMS["jobicy"](df), "jobicy",
        key=("id",), title=strip_html(_get("jobTitle")), company=_str("companyName"), location=_str("jobGeo", default=REMOTE),
        posted=_str("pubDate"), description=strip_html(_get("jobDescription")), url=_str("url"),
        employment_type=_str("jobType"), seniority=infer_seniority(_get("jobTitle")),
        salary_min=low, salary_max=high,
        currency=F.when(~F.coalesce(F.is_variant_null(_get("salaryCurrency", "variant")), F.lit(False)), stated),
        departments=industry, tags=industry,
    )


def himalayas(df: DataFrame) -> DataFrame:
    low, high = _amount("minSalary"), _amount("maxSalary")
    places = F.when(_is_list("locationRestrictions"), F.array_join(_text_list("locationRestrictions"), ", ")).otherwise(_get("locationRestrictions"))
    page = F.coalesce(blank_to_null(_get("applicationUrl")), F.concat(F.lit(HIMALAYAS_PAGE), _str("slug")))
    return _remote_board(
        ITEMS["himalayas"](df), "himalayas",
        key=("id", "slug"), source_id=_id("id", "slug"), title=_str("title"), company=_str("companyName"), location=first_filled(places, default=REMOTE),
        posted=_str("pubDate", "postedDate"), description=strip_html(_get("description")), url=page,
        employment_type=_str("type"), seniority=F.coalesce(blank_to_null(_get("seniority")), infer_seniority("title")),
        salary_min=low, salary_max=high, currency=default_currency(low.isNotNull() | high.isNotNull()),
        departments=singleton(_get("category")), tags=_text_list("tags"),
    )


def themuse(df: DataFrame) -> DataFrame:
    levels = _names("levels")
    return _listing(
        ITEMS["themuse"](df), "themuse", status="API_ACTIVE",
        key=("id",), title=_str("name"), company=_name_or_text("company"), location=F.array_join(_names("locations"), ", "),
        posted=_str("publication_date"), description=strip_html(_get("contents")), url=_str("refs.landing_page"),
        remote=remote_from_text("location", words=("flexible", "remote")),
        seniority=F.coalesce(F.get(levels, F.lit(0)), infer_seniority("title")), departments=_names("categories"),
    )


def rss(df: DataFrame) -> DataFrame:
    return _listing(
        ITEMS["rss"](df), "rss", status="UNVERIFIED",
        key=("link", "title"), source_id=_str("guid", "link"), title=_str("title"), company=_str("company", "author"),
        location=_str("location"), posted=_str("pubDate", "published"),
        description=strip_html(_str("description", "summary")), url=_str("link"),
        remote=remote_from_text("title", "location"), work_mode=infer_work_mode(first_filled("location", "title")),
        departments=singleton(_get("category")), tags=_text_list("categories"),
    )


MAPPINGS: dict[str, Callable[[DataFrame], DataFrame]] = {
    f.__name__: f for f in (greenhouse, lever, workable, ashby, remotive, remoteok, jobicy, himalayas, themuse, rss)
}
assert tuple(MAPPINGS) == SOURCES


def normalize(payloads: DataFrame, source: str) -> DataFrame:
    """Map documents of one source; an unknown source name is an error."""
    if source not in MAPPINGS:
        raise ValueError(f"unknown source {source!r}; expected one of {', '.join(SOURCES)}")
    return MAPPINGS[source](payloads)


def normalize_all(payloads: DataFrame, sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """Map a mixed frame by its `source` column. Documents of other sources are left out, see `unknown_sources`.

    With `source` as a partition folder of the landing zone each branch reads only its own files.
    """
    branches = [normalize(payloads.filter(F.col("source") == s), s) for s in sources]
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b)
    return out


def unknown_sources(payloads: DataFrame) -> DataFrame:
    return payloads.filter(~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False)))


def with_company_fallback(listings: DataFrame, fallback: str = "fallback_company") -> DataFrame:
    """Blank company names taken from the manifest's company."""
    return listings.withColumn("company", backfill_company("company", fallback)).drop(fallback)
