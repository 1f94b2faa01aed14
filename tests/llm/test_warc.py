import gzip
import hashlib
import os

import pytest

from tests.llm.conftest import rows_of
from vacancia.llm import warc
from vacancia.session import scratch_path

BIG = "<p>x</p>" * 200
PAGES = [(1, "http://a/1", BIG), (2, "http://a/2 x\r\ny", BIG), (3, None, BIG), (4, "http://b", "small"), (5, "http://c", "small"), (6, "http://d", None), (7, "http://e", ""), (None, "http://f", "é" * 600), (8, "http://g", "a\r\n\r\nb" * 300_000), (8, "http://g", "other"), (9, "u", "WARC/1.1\r\n\r\n" * 90)]


def expected():
    keep = {}
    for page_id, _, html in PAGES:
        keep[html or ""] = max(keep.get(html or "", -1), -1 if page_id is None else page_id)
    out = []
    for page_id, _, html in PAGES:
        data = (html or "").encode()
        revisit = len(data) >= 1000 and keep[html] not in (-1, page_id)
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keep[html] if revisit else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "mine", "mine") for p in PAGES], "page_id long, url string, html string, offset string, refers_to string")


def test_round_trip(spark, pages):
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    found = warc.archive(pages, scratch_path(spark, "w"))
    assert rows_of(found, *columns) == expected()
    payloads = {(r["page_id"], r["payload_digest"]): r["payload"] for r in found.collect() if r["record_type"] == "response"}
    assert all(hashlib.sha1(v).hexdigest() == k[1] for k, v in payloads.items())
    assert rows_of(warc.archive(pages.limit(0), scratch_path(spark, "w"))) == []


def test_files_and_sidecar(spark, pages):
    folder = scratch_path(spark, "w")
    whole = warc.write_monolithic(warc.with_roles(pages.coalesce(1)), folder, file_bytes=1 << 20)
    index = warc.normalise(whole, f"{folder}/members")
    assert sum(r["records"] for r in whole.collect()) == index.count() == len(PAGES)
    assert whole.count() > 1
    for path in {r["path"] for r in index.collect()}:
        local = path.removeprefix("file:")
        entries = [r for r in index.collect() if r["path"] == path]
        lines = [x.split("\t") for x in open(local + ".idx").read().splitlines()]
        assert [(str(r["offset"]), str(r["length"]), r["record_id"], r["record_type"]) for r in sorted(entries, key=lambda r: r["offset"])] == [tuple(x) for x in lines]
        assert sum(r["length"] for r in entries) == os.path.getsize(local)
        data = open(local, "rb").read()
        for r in entries:
            record = gzip.decompress(data[r["offset"] : r["offset"] + r["length"]])
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")


def test_broken_archives_are_errors(tmp_path):
    data = gzip.compress(warc.record_bytes(1, "u", b"payload" * 1000, None))
    assert len(list(warc.records(__import__("io").BytesIO(data + data)))) == 2  # several members are one stream
    with pytest.raises(ValueError):
        list(warc.records(__import__("io").BytesIO(gzip.compress(gzip.decompress(data)[:-10]))))
