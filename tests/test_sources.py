"""Feeds, manifests, overrides and odd payloads from hand-written files."""

import json

from pyspark.sql import functions as F

from vacancia.sources import feeds, landing, mappings


def docs(spark, *raw):
    return landing.parse_payloads(spark.createDataFrame([(f"f{i}", r) for i, r in enumerate(raw)], "file string, raw string"))


def test_odd_payloads(spark):
    parsed = docs(spark, '{"jobs":[{"id":1,"title":"A","location":null,"departments":null},5,"x"]}', "[]", "{}", "", "{", '[{"title":"No id"}]')
    rows = {r.title: r for r in mappings.greenhouse(parsed).collect()}
    assert set(rows) == {"A", "No id"}
    assert (rows["A"].location, rows["A"].departments, rows["No id"].source_id) == ("", [], "")
    bad = {r.file: r.reason for r in landing.rejects(parsed).collect()}
    assert bad == {"f3": "empty", "f4": "broken JSON"}


def test_lever_needs_a_list(spark):
    assert mappings.lever(docs(spark, '{"jobs":[{"id":1}]}')).count() == 0


def test_remoteok_first_element(spark):
    parsed = docs(spark, '[{"legal":"x"},{"id":"1","position":"P"}]', '[{"id":"2","position":"Only"}]')
    assert sorted(r.title for r in mappings.remoteok(parsed).collect()) == ["Only", "P"]


def test_unknown_sources(spark):
    df = spark.createDataFrame([("rss",), ("monster",), (None,)], "source string")
    assert mappings.unknown_sources(df).count() == 2


def test_feeds(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><item><title>Dev at A at B</title><category>x</category><category>y</category>'
        "<dc:creator> Ann </dc:creator><link>first</link><link>last</link></item></channel></rss>")
    (tmp_path / "b.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link href="h"/><published>2025-01-01</published></entry></feed>')
    (tmp_path / "c.xml").write_text("<rss><channel><item><title>lost</title></item><item><title>cut</channel></rss>")
    (tmp_path / "d.xml").write_text(" ")
    (item,) = feeds.scan_rss(spark, str(tmp_path)).collect()
    assert (item.company, item.category, item.author, item.link) == ("B", "x, y", "Ann", "last")
    (entry,) = feeds.scan_atom(spark, str(tmp_path)).collect()
    assert (entry.link, entry.pubDate) == ("h", "")
    assert feeds.scan_atom(spark, str(tmp_path), fixed=True).first().pubDate == "2025-01-01"
    counts = {r.file[-5:]: r.item_count for r in feeds.envelopes(feeds.scan_rss(spark, str(tmp_path)), feeds.feed_files(spark, str(tmp_path))).collect()}
    assert counts == {"a.xml": 1, "b.xml": 0, "c.xml": 0, "d.xml": 0}


def test_feed_elements_in_document_order(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<rss xmlns:dc="urn:d"><channel><item><dc:creator>C</dc:creator><author>A</author><location>L</location><region/></item>'
        "<item><author>A</author><dc:creator>C</dc:creator><region>R</region><location>L</location><title>x<b>y</b></title></item></channel></rss>")
    (tmp_path / "b.xml").write_text(
        '<feed xmlns="http://www.w3.org/2005/Atom"><entry><author><uri>u</uri></author><author><name> N </name></author><summary>S<i/></summary><content>C</content>'
        "<published>P</published></entry></feed>")
    (tmp_path / "c.xml").write_text("<rss><channel>\n<item><title>cut</channel></rss>")
    (tmp_path / "d.xml").write_text(" ")
    (tmp_path / "e.xml").write_text('<r xmlns="urn:other"><item><title>T</title></item><entry><title>T</title></entry></r>')
    parsed = feeds.parse(spark, str(tmp_path))
    rows = [(r.author, r.location, r.title, r.description, r.pubDate) for r in feeds.items_of(parsed).collect()]
    assert sorted(rows) == [("A", "", "", "", ""), ("C", "L", "x", "", ""), ("N", "", "", "S", "")]
    bad = {r.file[-5:]: (r.reason, r.error) for r in feeds.rejects_of(parsed).collect()}
    assert bad == {"c.xml": ("broken XML", "mismatched tag: line 2, column 18"), "d.xml": ("empty", "no element found: line 1, column 1")}
    env = {r.file[-5:]: (r.item_count, r.feed_url, r.error is None) for r in feeds.envelopes_of(parsed).collect()}
    assert env == {"a.xml": (2, "", True), "b.xml": (1, "", True), "c.xml": (0, "", False), "d.xml": (0, "", False), "e.xml": (0, "", True)}
    plan = feeds.scan_feeds(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_dimensions_and_override(spark, tmp_path):
    base, local = tmp_path / "companies.json", tmp_path / "companies.local.json"
    base.write_text(json.dumps({"_comment": "c", "companies": [{"name": "A", "ats": "lever", "slug": "a", "sectors": ["s"], "notes": ""}]}))
    assert [r.name for r in landing.scan_companies(spark, str(base), str(local)).collect()] == ["A"]
    local.write_text(json.dumps({"companies": [{"name": "Own", "ats": "ashby", "slug": "o", "sectors": [], "notes": ""}]}))
    assert [r.name for r in landing.scan_companies(spark, str(base), str(local)).collect()] == ["Own"]
    words = tmp_path / "sectors.json"
    words.write_text(json.dumps({"_comment": "text", "s": {"title_keywords": ["t"], "description_keywords": ["d", "e"], "exclude_keywords": ["x"]}}))
    got = {(r.sector, r.kind, r.keyword) for r in landing.scan_sector_keywords(spark, str(words)).collect()}
    assert got == {("s", "title", "t"), ("s", "description", "d"), ("s", "description", "e"), ("s", "exclude", "x")}


def test_paged_search_stops_at_last_page(spark):
    raw = [(q, p, json.dumps({"page_count": 3, "results": [{"id": p}]})) for q in (1, 2) for p in range(5)]
    df = spark.createDataFrame(raw, "q int, page int, raw string")
    parsed = landing.parse_payloads(df.withColumn("raw", F.when((F.col("q") == 2) & (F.col("page") == 2), "oops").otherwise(F.col("raw"))))
    got = sorted((r.q, r.page) for r in landing.merge_pages(parsed, 5, ["q"]).select("q", "page").collect())
    assert got == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 3)]
