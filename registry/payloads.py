"""Source payloads built by Spark from all parts, in every shape the mappings read.

A document holds the 50 parts of one key range, so no document and no group grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.tables import load, pick

DOC_ROWS = 50


def key() -> Column:
    return F.col("p_partkey")


def iso() -> Column:
    return F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (key() % 120).cast("int")), "yyyy-MM-dd")


def stamp() -> Column:
    return F.concat(iso(), F.lit("T10:00:00Z"))


def html() -> Column:
    return F.concat(F.lit("<p>Work on "), F.col("p_type"), F.lit("</p><ul><li>"), F.col("p_name"), F.lit("</li></ul> &amp; more"))


def title() -> Column:
    return F.concat(pick(["Director of ", "Senior ", "", "Junior "], key() % 4), F.col("p_name"))


def place() -> Column:
    return pick(["Remote", "Hybrid - Berlin", "Remote / office", "NYC", ""], F.col("p_size") % 5)


def _some(cond: Column, value: Column) -> Column:
    """A field that is left out of the document where the condition fails."""
    return F.when(cond, value)


def _obj(**fields: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _named(value: Column) -> Column:
    return _obj(name=value)


def _json(base: dict[str, Column], **either: tuple[Column, Column, Column]) -> Column:
    """One JSON object per part; a field given as (condition, a, b) takes the type of a or of b."""
    if not either:
        return F.to_json(_obj(**base))
    (name, (cond, a, b)), *rest = either.items()
    left = _json({**base, name: a}, **dict(rest))
    right = _json({**base, name: b}, **dict(rest))
    return F.when(cond, left).otherwise(right)


def greenhouse() -> Column:
    return _json({
        "id": key(), "title": title(), "location": _some(key() % 7 != 3, _named(place())),
        "departments": F.array(_named(F.col("p_type"))), "updated_at": _some(key() % 2 == 0, stamp()),
        "first_published_at": stamp(), "content": html(),
        "company_name": _some(key() % 3 == 0, F.col("p_brand")), "board_name": _some(key() % 3 == 1, F.lit("Board")),
        "absolute_url": F.concat(F.lit("https://boards.greenhouse.io/x/"), key().cast("string")),
    })


def lever() -> Column:
    base = {
        "id": key().cast("string"), "text": title(), "createdAt": _some(key() % 5 != 0, F.lit(1704067200000) + key() * 3600000),
        "lists": _some(key() % 2 == 0, F.array(_obj(text=F.lit("Needs"), content=html()))),
        "descriptionPlain": _some(key() % 3 == 0, F.concat(F.lit("Plain "), F.col("p_name"))), "description": html(),
        "company": _some(key() % 4 != 0, F.col("p_brand")), "hostedUrl": _some(key() % 2 == 1, F.concat(F.lit("https://h/"), key().cast("string"))),
        "applyUrl": F.concat(F.lit("https://a/"), key().cast("string")),
    }
    cats = {"location": place(), "commitment": F.lit("Full"), "team": _some(key() % 2 == 0, F.col("p_type")), "department": F.lit("Dept")}
    one = _obj(**cats, allLocations=place())
    many = _obj(**cats, allLocations=F.array(place(), F.lit("B")))
    return _json(base, categories=(key() % 3 == 0, many, one))


def workable() -> Column:
    return _json({
        "shortcode": _some(key() % 2 == 0, F.concat(F.lit("S"), key().cast("string"))), "id": key(), "title": title(),
        "location": _some(key() % 3 == 0, place()), "city": _some(key() % 3 == 1, F.lit("Oslo")), "country": _some(key() % 2 == 0, F.lit("Norway")),
        "telecommuting": _some(key() % 4 != 3, key() % 4 == 0), "employment_type": F.lit("Full-time"),
        "published_on": _some(key() % 2 == 1, iso()), "created_at": stamp(), "description": html(),
        "url": _some(key() % 3 != 0, F.concat(F.lit("https://w/"), key().cast("string"))), "application_url": F.concat(F.lit("https://wa/"), key().cast("string")),
        "department": _some(key() % 2 == 0, F.col("p_type")), "company": _some(key() % 5 != 0, F.col("p_brand")),
    })


def ashby() -> Column:
    comp = _obj(range=_obj(min=F.col("p_retailprice"), max=F.col("p_retailprice") + 500), currency=F.lit("EUR"))
    return _json(
        {
            "id": key().cast("string"), "title": title(), "compensation": _some(key() % 3 != 0, comp), "isRemote": _some(key() % 2 == 0, key() % 4 == 0),
            "employmentType": F.lit("FullTime"), "publishedDate": _some(key() % 2 == 0, iso()), "updatedAt": _some(key() % 3 == 0, stamp()),
            "descriptionHtml": _some(key() % 2 == 0, html()), "description": F.lit("plain"),
            "jobUrl": F.concat(F.lit("https://j/"), key().cast("string")), "organizationName": F.col("p_brand"),
            "department": F.col("p_type"),
        },
        location=(key() % 2 == 0, _named(place()), place()),
        tags=(key() % 3 == 0, F.array(_named(F.col("p_type")), _named(F.lit("x"))), F.split("p_name", " ")),
    )


def remotive() -> Column:
    return _json({
        "id": key(), "title": title(), "company_name": F.col("p_brand"), "candidate_required_location": _some(key() % 2 == 0, place()),
        "job_type": F.lit("full_time"), "publication_date": stamp(), "description": html(), "salary": F.lit("100k"),
        "url": F.concat(F.lit("https://r/"), key().cast("string")), "category": _some(key() % 3 != 0, F.col("p_type")), "tags": F.split("p_name", " "),
    })


def remoteok() -> Column:
    return _json(
        {
            "id": key().cast("string"), "position": title(), "company": F.col("p_brand"), "location": place(), "date": stamp(), "description": html(),
            "salary_max": key(), "url": F.concat(F.lit("https://ok/"), key().cast("string")), "apply_url": _some(key() % 2 == 0, F.lit("https://apply")),
            "tags": F.split("p_name", " "),
        },
        salary_min=(key() % 2 == 0, pick(["12", "100.5", "", " 700 "], F.floor(key() / 2) % 4), F.col("p_retailprice")),
    )


def jobicy() -> Column:
    """Every tenth currency is stated as null, which a struct field cannot be; a marker is put in and replaced."""
    return F.replace(_json(
        {
            "id": key(), "jobTitle": F.concat(title(), F.lit(" &amp; Co")), "companyName": F.col("p_brand"), "jobGeo": place(), "jobType": F.lit("full"),
            "salaryMin": _some(key() % 3 == 0, F.lit("n/a")), "annualSalaryMin": _some(key() % 2 == 0, (key() + 1).cast("string")), "salary_min": _some(key() % 5 == 0, key()),
            "annualSalaryMax": _some(key() % 4 == 0, key() + 9), "salaryCurrency": F.when(key() % 10 == 4, F.lit("NULL")).when(key() % 2 == 0, F.lit("EUR")),
            "pubDate": stamp(), "jobDescription": html(), "url": F.concat(F.lit("https://jb/"), key().cast("string")),
        },
        jobIndustry=(key() % 2 == 0, F.array(F.col("p_type"), F.lit("y")), F.col("p_type")),
    ), F.lit('"NULL"'), F.lit("null"))


def himalayas() -> Column:
    return _json(
        {
            "id": _some(key() % 2 == 0, key()), "slug": F.concat(F.lit("s-"), key().cast("string")), "title": title(), "companyName": F.col("p_brand"),
            "type": F.lit("Full Time"), "seniority": _some(key() % 3 == 0, F.lit("Senior Level")), "minSalary": _some(key() % 2 == 0, key()), "maxSalary": key() * 2,
            "pubDate": _some(key() % 2 == 0, stamp()), "postedDate": iso(), "description": html(),
            "applicationUrl": _some(key() % 4 == 0, F.lit("https://apply.example.com")), "category": F.col("p_type"), "tags": F.split("p_name", " "),
        },
        locationRestrictions=(key() % 2 == 0, F.array(F.lit("US"), F.lit("CA")), _some(key() % 3 == 0, F.lit("EU"))),
    )


def themuse() -> Column:
    return _json(
        {
            "id": key(), "name": title(), "locations": F.array(_named(place()), _named(pick(["Flexible / Anywhere", "Oslo"], key() % 2))),
            "levels": _some(key() % 3 != 0, F.array(_named(pick(["Senior Level", "Entry Level"], key() % 2)))), "categories": F.array(_named(F.col("p_type"))),
            "publication_date": stamp(), "contents": html(), "refs": _some(key() % 5 != 0, _obj(landing_page=F.concat(F.lit("https://m/"), key().cast("string")))),
        },
        company=(key() % 2 == 0, _named(F.col("p_brand")), F.col("p_brand")),
    )


def rss() -> Column:
    return _json({
        "link": _some(key() % 4 != 0, F.concat(F.lit("https://f/"), key().cast("string"))), "title": F.concat(title(), F.lit(" at "), F.col("p_brand")),
        "guid": _some(key() % 2 == 0, F.concat(F.lit("g"), key().cast("string"))), "company": _some(key() % 2 == 0, F.col("p_brand")), "author": F.lit("Ann"),
        "location": _some(key() % 3 == 0, place()), "pubDate": _some(key() % 2 == 0, F.lit("Mon, 06 Jan 2025 10:00:00 +0000")), "published": _some(key() % 3 == 0, stamp()),
        "description": _some(key() % 2 == 1, html()), "summary": F.lit("sum"), "category": F.col("p_type"), "categories": F.array("p_type"),
    })


ITEMS = {f.__name__: f for f in (greenhouse, lever, workable, ashby, remotive, remoteok, jobicy, himalayas, themuse, rss)}
ROOTS = {"lever": None, "remoteok": None, "themuse": "results", "rss": "items"}


def documents(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """doc, source, file, fallback_company, raw: all parts as documents of one source."""
    parts = load(spark, sf_dir, "part")
    items = parts.select(F.floor(key() / DOC_ROWS).alias("doc"), key().alias("k"), ITEMS[source]().alias("j"))
    listed = items.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "j"))), lambda x: x["j"]), ",").alias("body"))
    root = ROOTS.get(source, "jobs")
    if source == "remoteok":
        raw = F.concat(F.lit('[{"legal":"terms"},'), F.col("body"), F.lit("]"))
    elif root is None:
        raw = F.concat(F.lit("["), F.col("body"), F.lit("]"))
    elif source == "themuse":
        raw = F.concat(F.lit('{"page_count":3,"results":['), F.col("body"), F.lit("]}"))
    else:
        # Every third document is a bare list, the other shape the sources send.
        bare = F.concat(F.lit("["), F.col("body"), F.lit("]"))
        raw = F.when(F.col("doc") % 3 == 2, bare).otherwise(F.concat(F.lit(f'{{"{root}":['), F.col("body"), F.lit("]}")))
    return listed.select(
        "doc", F.lit(source).alias("source"), F.concat(F.lit(f"{source}-"), F.col("doc").cast("string"), F.lit(".json")).alias("file"),
        F.concat(F.lit("Owner "), (F.col("doc") % 4).cast("string")).alias("fallback_company"), raw.alias("raw"),
    )


def land(spark: SparkSession, docs: DataFrame, name: str) -> str:
    """Write documents (doc, raw) to the shared scratch folder, one file each, as a landing zone holds them."""
    from vacancia.session import scratch_path

    path = scratch_path(spark, name)
    docs.select("doc", "raw").repartition("doc").write.partitionBy("doc").text(path)
    return path


def land_files(spark: SparkSession, docs: DataFrame, name: str) -> str:
    """Write the `raw` of documents as one file each into one folder, for scans that need no number of the document.

    Spark numbers the files that a task writes, so neither a task nor a folder is spent on each.
    """
    from vacancia.session import scratch_path

    path = scratch_path(spark, name)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    docs.select("doc", "raw").repartition(parts, "doc").select("raw").write.option("maxRecordsPerFile", 1).text(path)
    return path


def rss_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSS 2.0 feeds of 50 parts: repeated categories, a namespaced author, every ninth feed cut off."""
    item = F.concat(
        F.lit("<item><title>"), title(), F.lit(" at "), F.replace("p_brand", F.lit("#"), F.lit(" &amp; ")), F.lit("</title><link>https://f/"), key().cast("string"),
        F.lit("</link><pubDate>Mon, 06 Jan 2025 10:00:00 +0000</pubDate><description>&lt;b&gt;"), F.col("p_type"), F.lit("&lt;/b&gt;</description><category>"),
        F.col("p_type"), F.lit("</category><category>B</category>"),
        F.when(key() % 2 == 0, F.lit("<dc:creator> Ann </dc:creator>")).otherwise("<author>Bob</author>"),
        F.when(key() % 3 == 0, F.concat(F.lit("<region>"), place(), F.lit("</region>"))).otherwise(""), F.lit("</item>"),
    )
    head = '<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>feed</title>'
    return _feed(spark, sf_dir, item, head, "</channel></rss>")


def atom_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atom feeds of 50 parts: some entries with only one of the two dates."""
    item = F.concat(
        F.lit("<entry><title> "), title(), F.lit(' </title><link href="https://a/'), key().cast("string"), F.lit('"/><published>'), stamp(), F.lit("</published>"),
        F.when(key() % 2 == 0, F.concat(F.lit("<updated>"), iso(), F.lit("</updated>"))).otherwise(""),
        F.lit("<summary>sum</summary>"), F.when(key() % 3 == 0, F.concat(F.lit("<content>"), F.col("p_type"), F.lit("</content>"))).otherwise(""),
        F.when(key() % 4 == 0, F.concat(F.lit('<category term="'), F.col("p_type"), F.lit('"/>'))).otherwise("<category>plain</category>"),
        F.lit("<author><name>"), F.replace("p_brand", F.lit("#"), F.lit(" ")), F.lit("</name></author></entry>"),
    )
    return _feed(spark, sf_dir, item, '<feed xmlns="http://www.w3.org/2005/Atom"><title>feed</title>', "</feed>")


def _feed(spark: SparkSession, sf_dir: str, item: Column, head: str, tail: str) -> DataFrame:
    items = load(spark, sf_dir, "part").select(F.floor(key() / DOC_ROWS).alias("doc"), key().alias("k"), item.alias("x"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda e: e["x"]), "\n")
    # Every ninth feed is cut off, inside an element or right behind one.
    end = F.when(F.col("doc") % 18 == 4, F.lit("<item><title>cut</entry>")).when(F.col("doc") % 18 == 13, F.lit("")).otherwise(F.lit(tail))
    return items.groupBy("doc").agg(body.alias("body")).select("doc", F.concat(F.lit(head), F.col("body"), end).alias("raw"))


def manifest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest per 50 parts: two company boards, two searches and a feed."""
    docs = load(spark, sf_dir, "part").select(F.floor(key() / DOC_ROWS).alias("doc")).distinct()
    n = F.col("doc").cast("string")

    def file(source, ext=".json"):
        return F.concat(F.lit(f"{source}-"), n, F.lit(ext))

    def board(source):
        return _obj(path=file(source), source=F.lit(source), slug=F.concat(F.lit("slug"), n), company=F.concat(F.lit("Owner "), (F.col("doc") % 4).cast("string")))

    def search(source):
        return _obj(path=file(source), source=F.lit(source), params=F.concat(F.lit("page="), n))

    doc = _obj(
        mode=F.lit("prefetched"), fetched_at=F.lit("2024-04-01T00:00:00Z"),
        ats_files=F.array(board("greenhouse"), board("workable")), api_files=F.array(search("remotive"), search("themuse")),
        rss_files=F.array(_obj(path=file("rss"), source=F.lit("rss"), feed_url=F.concat(F.lit("https://feed/"), n))),
    )
    return docs.select("doc", F.to_json(doc).alias("raw"))


def company_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company files of 50 suppliers each, with the remark the file format allows."""
    from registry.tables import companies

    rows = companies(spark, sf_dir).withColumn("doc", F.floor(F.regexp_extract("name", r"(\d+)", 1).cast("bigint") / DOC_ROWS))
    return rows.groupBy("doc").agg(F.collect_list(F.struct("name", "ats", "slug", "sectors", "notes")).alias("companies")).select(
        "doc", F.to_json(F.struct(F.lit("remark").alias("_comment"), "companies")).alias("raw"))


def sector_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sector keyword file: a few sectors with their distinct words, so it stays small."""
    from registry.tables import sector_keywords

    words = sector_keywords(spark, sf_dir).groupBy("sector").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") == "title", F.col("keyword")))).alias("title_keywords"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "description", F.col("keyword")))).alias("description_keywords"),
        F.array(F.lit("intern")).alias("exclude_keywords"))
    body = words.select(F.concat(F.lit('"'), F.col("sector"), F.lit('":'), F.to_json(F.struct("title_keywords", "description_keywords", "exclude_keywords"))).alias("b"))
    return body.agg(F.concat(F.lit('{"_comment":"remark",'), F.array_join(F.array_sort(F.collect_list("b")), ","), F.lit("}")).alias("raw")).withColumn("doc", F.lit(0))
