"""Rules that small inputs decide: empty ids, null groups, dates, two stages, pages, late rows."""

from pyspark.sql import functions as F

from vacancia.operators import dedup, match, order, report
from vacancia.plans.search import search_pool
from vacancia.sources import landing, mappings
from vacancia.streaming import incremental


def test_rank_is_the_same_on_both_sides_of_the_group_limit(spark):
    df = spark.createDataFrame([(i, None if i % 3 else "a") for i in range(2500)], "pos long, source string")
    low, high = (sorted(r.pos for r in order.top_per_source(df, n, "pos").collect()) for n in (order.GROUP_LIMIT, order.GROUP_LIMIT + 1))
    assert len(low) == 834 + 1000 and len(high) == 834 + 1001 and set(low) < set(high)


def test_median_is_exact(spark):
    df = spark.range(25_001).select(F.col("id").cast("double").alias("salary_min"), F.lit(None).cast("double").alias("salary_max"), F.lit("EUR").alias("salary_currency"), F.lit(None).cast("string").alias("seniority"))
    row = report.salary_ranges(df).first()
    assert (row.listings, row.lowest, row.highest, row.median_min) == (25_001, 0.0, 25_000.0, 12_500.0)


def test_number_zero_is_no_id(spark):
    raw = spark.createDataFrame([('{"jobs":[{"id":0,"slug":"s"},{"id":"0","slug":"s"},{"slug":"s"},{"id":7}]}',)], "raw string")
    docs = landing.parse_payloads(raw)
    got = [(r.id, r.source_id) for r in mappings.normalize(docs, "himalayas").collect()]
    assert got[0] == got[2] and got[0][1] == "s" and got[1][1] == "0" and got[3][1] == "7"
    board = [(r.id, r.source_id) for r in mappings.normalize(docs, "greenhouse").collect()]
    assert board[0][0] == board[2][0] and board[0][1] == "0" and board[1][0] != board[0][0]


def test_stated_null_currency_stays_null(spark):
    raw = spark.createDataFrame([('{"jobs":[{"id":1,"salaryMin":5,"salaryCurrency":null},{"id":2,"salaryMin":5},{"id":3,"salaryMin":5,"salaryCurrency":"EUR"}]}',)], "raw string")
    assert [r.salary_currency for r in mappings.normalize(landing.parse_payloads(raw), "jobicy").collect()] == [None, "USD", "EUR"]


def test_a_list_page_is_skipped(spark):
    rows = [(0, '{"page_count":5,"results":[]}'), (1, "[]"), (2, '{"page_count":5,"results":[]}')]
    docs = landing.parse_payloads(spark.createDataFrame([("q", *r) for r in rows], "q string, page int, raw string"))
    assert sorted(r.page for r in landing.merge_pages(docs, 5, ["q"]).collect()) == [0, 2]


def test_pairs_reach_two_levels(spark):
    listings = spark.createDataFrame([(s,) for s in ("junior", "mid", "senior", "director", "executive", "odd")], "seniority string")
    profiles = spark.createDataFrame([("p", ["Mid"]), ("q", ["odd"])], "profile_id string, seniority_targets array<string>")
    got = {(r.profile_id, r.seniority): r.p for r in match.listing_profile_pairs(listings, profiles).withColumn("p", match.seniority_points(F.col("seniority"), F.col("seniority_targets"))).collect()}
    assert got == {("p", "junior"): 10.0, ("p", "mid"): 20.0, ("p", "senior"): 10.0, ("p", "director"): 0.0, ("q", "odd"): 0.0}


LISTED = "pos long, source string, source_id string, url string, company string, title string, salary_min double, salary_max double, salary_currency string, posted_date_raw string, posted_date date, employment_type string, tags array<string>"


def test_typed_date_follows_the_raw_one(spark):
    rows = [(0, 0, "soon", None), (1, 0, "2024-01-01", "2024-01-01"), (2, 2, "", None), (3, 2, "later", None), (4, 2, "2024-02-02", "2024-02-02")]
    df = spark.createDataFrame(rows, "ord long, leader long, posted_date_raw string, posted_date string").withColumn("posted_date", F.col("posted_date").cast("date"))
    got = {r.ord: (r.posted_date_raw, r.posted_date) for r in dedup.fill_fields(df).collect()}
    assert got == {0: ("soon", None), 2: ("later", None)}


def test_two_stages_keep_earlier_alternates(spark):
    def listing(pos, source, tags):
        return (pos, source, str(pos), f"u{pos}", "Acme", "Engineer of things", None, None, None, "", None, "", tags)

    first = spark.createDataFrame([listing(0, "remotive", ["a"]), listing(1, "jobicy", ["b"])], LISTED)
    one = dedup.nested(dedup.deduplicate(first, "pos"), size=None)
    second = one.unionByName(spark.createDataFrame([listing(2, "rss", ["c"])], LISTED), allowMissingColumns=True)
    two = dedup.nested(dedup.deduplicate(second, "pos")).collect()
    assert len(two) == 1 and two[0].tags == ["a", "b", "c"]
    assert [a.url for a in two[0].alternate_sources] == ["u1", "u2"]


def test_large_clusters_come_in_chunks(spark):
    df = spark.range(26).select(
        F.col("id").alias("ord"), F.lit(0).cast("long").alias("leader"), F.lit("rss").alias("source"), F.concat(F.lit("u"), "id").alias("url"), F.col("id").cast("string").alias("source_id"),
        F.lit(None).cast("double").alias("salary_min"), F.array(F.concat(F.lit("t"), "id")).alias("tags"))
    rows = sorted(dedup.nested(dedup.from_clusters(df), size=10).collect(), key=lambda r: r.chunk)
    assert [len(r.alternate_sources) for r in rows] == [10, 10, 5] and [len(r.tags) for r in rows] == [10, 10, 6]
    assert [a.url for r in rows for a in r.alternate_sources] == [f"u{i}" for i in range(1, 26)]


def test_nameless_rows_are_left_alone(spark):
    rows = [(i, c, t, "", None, None, None, "", "") for i, (c, t) in enumerate([("", ""), (None, None), ("A", "b"), ("a", "B"), ("a", "")])]
    df = spark.createDataFrame(rows, "pos long, company string, title string, location string, salary_min double, salary_max double, posted_date date, description_text string, employment_type string")
    assert sorted(r.pos for r in dedup.keep_most_detailed(df, "pos").collect()) == [0, 1, 2, 4]


def test_late_rows_count(spark, tmp_path):
    schema = "id string, source string, seen_at timestamp"
    batches = [[("a", "x", "2024-06-01 10:00:00"), ("b", "x", "2024-06-01 11:00:00")], [("a", "x", "2024-06-02 10:00:00"), ("c", "x", "2023-01-01 00:00:00")]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "id string, source string, seen_at string").withColumn("seen_at", F.col("seen_at").cast("timestamp")).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).json(f"{tmp_path}/in")
        first = incremental.suppress_reposts(stream, f"{tmp_path}/ids", f"{tmp_path}/ids-progress")
        days = incremental.new_per_day(stream, f"{tmp_path}/days", f"{tmp_path}/days-progress")
        assert sorted(r.id for r in first.collect()) == [["a", "b"], ["a", "b", "c"]][n]
    assert {(str(r.day), r.listings) for r in days.collect()} == {("2024-06-01", 2), ("2024-06-02", 1), ("2023-01-01", 1)}


def test_every_listing_meets_every_profile(spark):
    levels = ("junior", "Mid", "executive", "Senior Level", "Entry Level", "", None)
    listings = spark.createDataFrame([(s,) for s in levels], "seniority string")
    profiles = spark.createDataFrame([("p", ["junior"]), ("q", ["odd"]), ("n", [])], "profile_id string, seniority_targets array<string>")
    pairs = match.every_pair(listings, profiles).withColumn("p", match.seniority_points(F.col("seniority"), F.col("seniority_targets")))
    got = {(r.profile_id, r.seniority): r.p for r in pairs.collect()}
    worth = {("p", "junior"): 20.0, ("p", "Mid"): 10.0}
    assert got == {(p, s): worth.get((p, s), 0.0) for p in "pqn" for s in levels}


def test_search_pool(spark):
    rows = [
        (0, "https://a/1", "Acme", "Dev", "", None), (1, "https://a/1", "ACME", "dev", "long text", "2024-03-01"), (2, "https://a/2", "Tide", "Ops", "", None),
        (3, "https://boards.greenhouse.io/x/jobs/1", "X", "Y", "", None), (4, "https://a/4", "Old", "Ops", "t", "2023-01-01"), (5, "https://a/5", "Shut", "Ops", "", None),
        (6, "https://a/6", "", "", "", None), (7, "https://a/7", None, None, "", None), (8, None, "No", "Address", "", None)]
    hits = spark.createDataFrame(rows, "pos long, url string, company string, title string, description_text string, d string").withColumns(
        {"posted_date": F.to_date("d"), "location": F.lit(""), "salary_min": F.lit(None).cast("double"), "salary_max": F.lit(None).cast("double"),
         "employment_type": F.lit(""), "source": F.lit("web"), "source_id": F.lit("")})
    checks = spark.createDataFrame([("https://a/1", "VERIFIED", "r"), ("https://a/2", "UNVERIFIABLE", "r"), ("https://a/5", "EXPIRED", "r"),
                                    ("https://boards.greenhouse.io/x/jobs/1", "EXPIRED", "r")], "url string, status string, reason string")
    pool = search_pool(hits, checks, F.lit("2024-04-01").cast("date"), "pos")
    assert {r.pos: r.verification_status for r in pool.collect()} == {1: "VERIFIED", 2: "UNVERIFIED", 3: "GUARANTEED", 6: "UNVERIFIED", 7: "UNVERIFIED", 8: "UNVERIFIED"}
    assert search_pool(hits.limit(0), checks.limit(0), F.lit("2024-04-01").cast("date"), "pos").count() == 0
