"""Golden values of the scalar functions, filters and scores."""

import datetime as dt

from pyspark.sql import functions as F

from vacancia.functions import html, infer, similarity, text
from vacancia.operators import filters as fl
from vacancia.operators import match, verify


def values(spark, items, expr, kind="string"):
    """expr over one column `x`, in input order."""
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_strip_html(spark):
    cases = {
        "<p>a</p><p>b</p>": "ab", "&lt;p&gt;Hi&lt;/p&gt;": "<p>Hi</p>", "<script>var a=1;</script>t<style>b{}</style>": "var a=1;tb{}",
        "a<!-- c -->b": "ab", "R&D": "", ' <p class="x"> hi &amp;lt;</p>': "hi &lt;", "x &copy; y": "x © y", "a < b": "a < b", None: "", "  t  ": "t",
    }
    assert values(spark, cases, html.strip_html("x")) == list(cases.values())
    assert values(spark, cases, html.strip_html("x", "exact")) == list(cases.values())
    assert values(spark, ["R&D", "<b>x</b>"], html.strip_html("x", "fast")) == ["R&D", "x"]


def test_strip_html_forms_agree(spark):
    parts = ["<p>", "</p>", "<br/>", "<a href=\"u?a=1&b=2\">", "text ", "&amp;", "&lt;", "&eacute;", "<!-- x -->", "<", "&", "<b", ">", "<script>", "</script>", "\n", "<img src='a>b'>"]
    import random

    rng = random.Random(7)
    items = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(600)]
    assert values(spark, items, html.strip_html("x")) == [html.text_nodes(i) for i in items]


def test_make_id(spark):
    assert values(spark, ["1"], text.make_id("greenhouse", F.col("x"))) == ["7ae8263a9349"]
    one, two = values(spark, ["", None], text.make_id("rss", F.col("x")))
    assert one == two


def test_seniority(spark):
    cases = {
        "Director of Product": "executive", "Coordinator": "executive", "Contractor": "executive", "Head of Design": "director", "Principal Engineer": "director",
        "Sr Engineer": "senior", "Team Lead": "senior", "International Sales": "junior", "VP": "mid", "Data Scientist": "mid", None: "mid",
    }
    assert values(spark, cases, infer.infer_seniority("x")) == list(cases.values())
    assert values(spark, ["Director of Product", "Contractor", "International Sales", "VP"], infer.infer_seniority("x", fixed=True)) == ["director", "mid", "mid", "executive"]


def test_work_mode(spark):
    cases = {"Remote / office": "hybrid", "Remote": "remote", "Hybrid - Berlin": "hybrid", "NYC": "onsite", None: "onsite"}
    assert values(spark, cases, infer.infer_work_mode("x")) == list(cases.values())


def test_dates(spark):
    raw = ["Mon, 06 Jan 2025 10:00:00 +0000", "2024-02-03T00:00:00Z", "soon", ""]
    assert values(spark, raw, infer.date_prefix("x")) == ["Mon, 06 Ja", "2024-02-03", "soon", ""]
    assert values(spark, raw, infer.typed_date("x")) == [dt.date(2025, 1, 6), dt.date(2024, 2, 3), None, None]


def test_company_and_title(spark):
    assert values(spark, ["Data Engineer at Acme at Home", "PM"], text.company_from_title("x")) == ["Home", ""]
    cases = {"Acme Inc.": "acme", "Acme, Inc": "acme", "X Corp Ltd": "x", "X Ltd Corp": "x ltd", "Brand#12 LLC": "brand12", "株式会社": "", None: ""}
    assert values(spark, cases, infer.company_key("x")) == list(cases.values())
    cases = {"Senior Engineer (Remote, US)": "senior engineer", "Full-Time Remote Data Scientist": "data scientist", "Engineer - Remote": "engineer -"}
    assert values(spark, cases, infer.title_key("x")) == list(cases.values())


def test_ratio(spark):
    df = spark.createDataFrame([("acme", "acme labs"), ("stripe", "stripes"), ("tide", "diet"), ("diet", "tide"), ("", "")], "a string, b string")
    got = [round(r[0], 3) for r in df.select(similarity.ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [0.615, 0.923, 0.25, 0.5, 0.0]


def test_keyword_score(spark):
    df = spark.createDataFrame([("Product Manager", "design systems", "c", [], []), ("Data Intern", "x", "c", [], [])],
                               "title string, description_text string, company string, departments array<string>, tags array<string>")
    a, b = fl.score_keywords(df, ["product", "design"]).select("preliminary_relevance_score", "matched_keywords").collect()
    assert (a[0], a[1], b[0], b[1]) == (66.7, ["product", "design"], 0.0, [])
    many = ["product"] + [f"k{i}zz" for i in range(15)]
    assert fl.score_keywords(df, many).first().preliminary_relevance_score == 6.2
    assert fl.score_keywords(df, ["data"], ["intern"]).count() == 1
    assert [r.preliminary_relevance_score for r in fl.score_keywords(df, [], ["intern"]).collect()] == [50.0, 50.0]
    assert fl.filter_and_score(df, fl.SearchConfig(["zzz"])).count() == 2


def test_search_config_text():
    cfg = fl.SearchConfig.from_text(" data, ,ML ", "mid", "")
    assert (cfg.keywords, cfg.seniority, cfg.exclude_keywords) == (("data", "ML"), ("mid",), ())


def test_age_bands(spark):
    as_of = dt.date(2024, 6, 1)
    days = [as_of - dt.timedelta(d) for d in (59, 60, 90, 91)] + [None]
    assert values(spark, days, fl.age_band("x", F.lit(as_of)), "date") == ["fresh", "stale", "stale", "expired", "date unknown"]


def test_page_checks(spark):
    rows = [
        ("u1", 404, "u1", "x"), ("u2", 410, "u2", "x"), ("u3", 403, "u3", "x"), ("u4", 0, "u4", "x"), ("u5", 500, "u5", "x"), ("u6", 200, "u6", "Position Has Been Filled"),
        ("u7", 200, "https://x.com/us/careers/", "ok"), ("u8", 200, "u8", ""), ("u9", 200, "https://x.com/positions", "ok"),
    ]
    pages = spark.createDataFrame(rows, "url string, http_code int, final_url string, body string")
    shell = {r.url: r.status for r in verify.check_pages(pages).collect()}
    js = {r.url: r.status for r in verify.check_pages(pages, "js").collect()}
    assert [shell[f"u{i}"] for i in range(1, 10)] == ["EXPIRED"] * 2 + ["UNVERIFIABLE"] * 3 + ["EXPIRED"] * 2 + ["UNVERIFIABLE", "VERIFIED"]
    assert [js[f"u{i}"] for i in range(6, 10)] == ["EXPIRED", "VERIFIED", "VERIFIED", "EXPIRED"]


def test_tiers(spark):
    assert values(spark, [80.0, 79.5, 60.0, 40.0, 39.9], match.tier(F.col("x")), "double") == [1, 2, 2, 3, None]


def test_unknown_source():
    import pytest

    from vacancia.sources import mappings

    with pytest.raises(ValueError):
        mappings.normalize(None, "monster")
