"""A small landing zone through every stage."""

import json

from pyspark.sql import functions as F

from vacancia.operators import sinks
from vacancia.operators.filters import SearchConfig
from vacancia.plans import matching


def test_landing_to_report(spark, tmp_path):
    boards, feeds_dir, manifest = tmp_path / "boards", tmp_path / "feeds", tmp_path / "manifest.json"
    boards.mkdir(), feeds_dir.mkdir()
    job = {"id": 1, "title": "Senior Data Scientist", "location": {"name": "Remote"}, "updated_at": "2024-03-20T00:00:00Z", "content": "<p>python and sql</p>", "absolute_url": "https://g/1"}
    (boards / "greenhouse-acme.json").write_text(json.dumps({"jobs": [job]}))
    twin = {"id": 9, "title": "Senior Data Scientist (Remote)", "company_name": "Acme Inc", "url": "https://r/9", "publication_date": "2024-03-01", "description": "sql", "tags": ["x"]}
    other = {"id": 10, "title": "Senior Baker", "company_name": "Bread", "url": "https://r/10", "publication_date": "2023-01-01", "description": "data", "tags": []}
    (boards / "remotive.json").write_text(json.dumps({"jobs": [twin, other]}))
    (boards / "broken.json").write_text("{")
    manifest.write_text(json.dumps({
        "mode": "prefetched", "fetched_at": "t",
        "ats_files": [{"path": "greenhouse-acme.json", "source": "greenhouse", "slug": "acme", "company": "Acme"}],
        "api_files": [{"path": "remotive.json", "source": "remotive", "params": ""}], "rss_files": []}))
    (feeds_dir / "f.xml").write_text("<rss><channel><item><title>Senior data engineer at Tide</title><link>https://f/1</link><pubDate>Mon, 18 Mar 2024 10:00:00 +0000</pubDate></item></channel></rss>")
    cfg = SearchConfig(["data", "python"], ["senior"])
    a, b = matching.scan_boards(spark, str(boards), str(manifest), cfg), matching.scan_feeds(spark, str(feeds_dir), cfg)
    assert {r.company for r in a.collect()} == {"Acme", "Acme Inc", "Bread"}
    plan = a._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan and "FileScan json" not in plan and plan.count("PartitionFilters: [isnotnull(source") == len(matching.ATS_SOURCES + matching.API_SOURCES)
    pages = spark.createDataFrame([("https://f/1", 200, "https://f/1", "open")], "url string, http_code int, final_url string, body string")
    profile = spark.createDataFrame(
        [("p", ["python"], ["senior"], ["finance"], ["data"], [], ["remote", "onsite"], ["sql"], ["crypto"])],
        "profile_id string, skills array<string>, seniority_targets array<string>, sectors array<string>, keywords array<string>, exclude_keywords array<string>, "
        "work_modes array<string>, value_terms array<string>, dealbreaker_terms array<string>")
    companies = spark.createDataFrame([("ACME Ltd.", ["finance", "tools"]), ("Other", ["health"])], "name string, sectors array<string>")
    terms = spark.createDataFrame([("finance", "title", "bank"), ("finance", "description", "ledger"), ("finance", "exclude", "data"), ("health", "title", "nurse")], "sector string, kind string, keyword string")
    out = matching.merge_and_match([a, None, b], ["source", "id"], pages, profile, ["python", "sql"], F.lit("2024-04-01").cast("date"), companies, terms)
    got = {r.url: r.verification_status for r in out.listings.collect()}
    assert got == {"https://g/1": "GUARANTEED", "https://f/1": "VERIFIED"}
    assert [r.source for r in out.duplicates.alternates.collect()] == ["remotive"]
    scores = {r.url: r.match_score for r in out.scored.collect()}
    # skills 15 of 30, level 20, shared sector 20, mode 15, values 10, recency 5
    assert scores["https://g/1"] == 85.0
    # no sector: nothing of the company or the text belongs to finance
    sectors = {r.url: (r.score_sector, r.rank) for r in out.scored.collect()}
    assert sectors == {"https://g/1": (20.0, 1), "https://f/1": (0.0, 1)}
    listed = {r.url: (r.place, list(r.tags), [a.source for a in r.alternate_sources]) for r in out.listings.collect()}
    assert listed["https://g/1"] == (0, ["x"], ["remotive"]) and listed["https://f/1"][0] == 1
    sinks.write_report(out.sections, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report" / "pool")).first().small_pool


def test_large_clusters_are_scored_whole(spark, monkeypatch):
    monkeypatch.setattr(matching.dedup.array_chunks, "__defaults__", (2,))
    tags = [f"t{i}" for i in range(5)] + ["machine", "learning", "crypto"]
    schema = "id string, source string, source_id string, url string, company string, title string, description_text string, departments array<string>, tags array<string>, seniority string, work_mode string, location string, " \
             "verification_status string, salary_min double, salary_max double, salary_currency string, posted_date_raw string, posted_date date, employment_type string, matched_keywords array<string>"
    rows = [(f"i{i}", "rss", str(i), f"u{i}", "Acme", "Engineer of things", "", [], [t], "Senior Level", "remote", "", "UNVERIFIED", None, None, None, "", None, "", []) for i, t in enumerate(tags)]
    listings = spark.createDataFrame(rows, schema)
    pages = spark.createDataFrame([], "url string, http_code int, final_url string, body string")
    profiles = spark.createDataFrame(
        [(p, ["machine learning"], ["junior"], ["x"], ["ai"], [], ["remote"], ["t4"], bad) for p, bad in (("p", []), ("q", ["crypto"]))],
        "profile_id string, skills array<string>, seniority_targets array<string>, sectors array<string>, keywords array<string>, exclude_keywords array<string>, "
        "work_modes array<string>, value_terms array<string>, dealbreaker_terms array<string>")
    companies = spark.createDataFrame([], "name string, sectors array<string>")
    terms = spark.createDataFrame([("x", "title", "learning")], "sector string, kind string, keyword string")
    out = matching.merge_and_match([listings], ["source", "source_id"], pages, profiles, ["machine learning"], F.lit("2024-04-01").cast("date"), companies, terms)
    found = sorted(out.listings.collect(), key=lambda r: r.chunk)
    assert [t for r in found for t in r.tags] == tags and [a.url for r in found for a in r.alternate_sources] == [f"u{i}" for i in range(1, 8)]
    # q's dealbreaker is in the last chunk; skills 30 (across two chunks or not), sector 10, mode 15, values 10, no date 3
    assert [(r.profile_id, r.match_score, r.tier) for r in out.scored.collect()] == [("p", 68.0, 2)]
    assert out.sections["pool"].first().pool_size == 1 and out.sections["channels"].filter("channel IS NULL").first().listings == 1
    again = matching.dedup.deduplicate(out.listings.drop("place"), "source", "source_id")
    merged = matching.dedup.nested(again, size=None).collect()
    assert len(merged) == 1 and merged[0].tags == tags and [a.url for a in merged[0].alternate_sources] == [f"u{i}" for i in range(1, 8)]
