"""WARC archives: writing, normalising whole-file gzip to one member per record, reading by offset.

A record's block is an HTTP response whose body is the payload. Archives live in a shared folder that
Spark's tasks reach through Arrow file systems; tables of file names say which attempts count, so a task
that ran twice leaves a file that nothing refers to.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancia.llm.common import stored

REVISIT_LEAST = 1000  # smaller payloads are always written out
FILE_BYTES = 256 << 20  # a monolithic file is closed once it has taken in so many bytes: one task inflates it
CHUNK = 1 << 20
READ_BYTES = 8 << 20  # bytes of records a reading task takes, about
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "path string, records long"
INDEX = "path string, offset long, length long, record_id string, record_type string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, payload binary"


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; `file:/x`, as Hadoop writes it, is a local path."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
        payload = b""
    head += [f"WARC-Payload-Digest: {digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def with_roles(pages: DataFrame) -> DataFrame:
    """page_id, url, html, refers_to: of equal payloads of REVISIT_LEAST bytes or more the largest page_id is written out.

    Only digests that several pages have become a table; the join to it deals a hot digest out anew, as the
    table is read from files.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html")).withColumn("_n", F.octet_length("html"))
    rows = rows.withColumn("_digest", F.when(F.col("_n") >= REVISIT_LEAST, F.unhex(F.sha1("html"))))
    groups = rows.filter("_digest IS NOT NULL").groupBy("_digest", "_n").agg(F.max("page_id").alias("_keep"), F.count("*").alias("_rows"))
    shared = stored(groups.filter("_rows > 1").select("_digest", "_n", "_keep"), "warc-shared")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_keep")), F.col("_keep"))
    return rows.join(shared, ["_digest", "_n"], "left").select("page_id", "url", "html", refers.alias("refers_to"))


def write_monolithic(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write (page_id, url, html, refers_to) as archives of one gzip stream each; returns their FILES table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = located(folder)
        store.create_dir(base, recursive=True)
        out = None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, count, taken = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, gz = store.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                data = record_bytes(row["page_id"], row["url"], row["html"].encode(), row["refers_to"])
                out.write(gz.compress(data))
                count, taken = count + 1, taken + len(data)
                if taken >= file_bytes:
                    out.write(gz.flush())
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": count}])
        if out is not None:
            out.write(gz.flush())
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": count}])

    return stored(pages.mapInArrow(run, FILES), "warc-files")


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of one or several members, a chunk at a time."""
    member, data = zlib.decompressobj(31), stream.read(CHUNK)
    while data:
        while data:
            yield member.decompress(data, CHUNK)
            data = member.unconsumed_tail
            if member.eof:
                data, member = member.unused_data, zlib.decompressobj(31)
        data = stream.read(CHUNK)
    if member.flush():
        raise ValueError("gzip stream ends inside a block")


def records(stream) -> Iterator[bytes]:
    """Whole records of an inflated stream; memory holds one record and one chunk."""
    held, chunks = bytearray(), inflated(stream)

    def need(enough) -> bool:
        while not enough():
            chunk = next(chunks, None)
            if chunk is None:
                return False
            held.extend(chunk)
        return True

    while need(lambda: held):
        at = [0]

        def head_ends() -> bool:
            found = held.find(b"\r\n\r\n", max(0, at[0] - 3))
            at[0] = found + 4 if found >= 0 else len(held)
            return found >= 0

        if not need(head_ends):
            raise ValueError("archive ends inside a record's header")
        size = int(header(bytes(held[: at[0]]))["content-length"])
        end = at[0] + size + 4
        if not need(lambda: len(held) >= end):
            raise ValueError("archive ends inside a record")
        yield bytes(held[:end])
        del held[:end]


def header(data: bytes) -> dict[str, str]:
    """Fields of a header by lower-case name."""
    lines = data.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if v}


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive of a FILES table record by record, a gzip member each; returns the INDEX table.

    A whole-file stream cannot be entered in the middle, so one task inflates it, once and in chunks. Beside
    each new archive stands its sidecar `.idx`: a line of offset, length, record id and type per record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                yield from rewrite(path)

    def rewrite(path: str) -> Iterator[pa.RecordBatch]:
        store, source = located(path)
        target, base = located(folder)
        target.create_dir(base, recursive=True)
        name, offset, rows = f"{uuid.uuid4().hex}.warc.gz", 0, []
        with store.open_input_stream(source, compression=None) as stream, target.open_output_stream(f"{base}/{name}", compression=None) as out, target.open_output_stream(f"{base}/{name}.idx") as side:
            for data in records(stream):
                gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = gz.compress(data) + gz.flush()
                out.write(member)
                fields = header(data[: data.find(b"\r\n\r\n")])
                row = {"path": f"{folder}/{name}", "offset": offset, "length": len(member), "record_id": fields["warc-record-id"], "record_type": fields["warc-type"]}
                side.write("{offset}\t{length}\t{record_id}\t{record_type}\n".format(**row).encode())
                offset, rows = offset + len(member), [*rows, row] if len(rows) < 500 else [row]
                if len(rows) == 500:
                    yield pa.RecordBatch.from_pylist(rows)
        if 0 < len(rows) < 500:
            yield pa.RecordBatch.from_pylist(rows)

    spark = files.sparkSession
    tasks = max(1, min(files.count(), 4 * spark.sparkContext.defaultParallelism))
    return stored(files.select("path").repartition(tasks).mapInArrow(run, INDEX), "warc-index")


def page_of(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").rstrip(">")
    return int(digits) if digits else None


def parsed(data: bytes) -> dict:
    """RECORDS row of a whole record; a written-out payload must have the digest its header states."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = header(head)
    http, _, body = block[:-4].partition(b"\r\n\r\n")
    stated = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    row = {"page_id": page_of(fields["warc-record-id"]), "payload_digest": stated, "record_type": fields["warc-type"], "refers_to": page_of(fields.get("warc-refers-to")), "target_uri": fields.get("warc-target-uri")}
    if row["record_type"] == "revisit":
        return row | {"payload_bytes": int(header(http)["content-length"]), "payload": None}
    if hashlib.sha1(body).hexdigest() != stated:
        raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
    return row | {"payload_bytes": len(body), "payload": body}


def read_records(index: DataFrame) -> DataFrame:
    """Read the records that a stored INDEX table names, each by its own offset and length.

    As many tasks read as the bytes of the records need, however few splits the index has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, file = None, None
        for batch in batches:
            rows, size = [], 0
            for at in batch.to_pylist():
                if at["path"] != last:
                    if file is not None:
                        file.close()
                    store, path = located(at["path"])
                    last, file = at["path"], store.open_input_file(path)
                file.seek(at["offset"])
                rows.append(parsed(zlib.decompress(file.read(at["length"]), 31)))
                size += rows[-1]["payload_bytes"]
                if size >= CHUNK * 8:
                    yield records_batch(rows)
                    rows, size = [], 0
            if rows:
                yield records_batch(rows)

    size = index.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    near = F.floor(F.col("offset") / READ_BYTES)  # neighbours in a file stay together
    dealt = index.repartition(max(1, -(-size // READ_BYTES)), "path", near).sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(run, RECORDS)


_RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("payload", pa.binary())])


def records_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _RECORDS)


def archive(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages (page_id, url, html) as monolithic archives, normalise them, and read all records back.

    Returns the RECORDS columns, one row per page. A null html is an empty payload; a null url writes no
    target; a null page_id an empty id, read back as null. Pages with equal large payloads and the same
    largest page_id are all written out. Extra columns are not read; no pages make no files and no rows.
    """
    files = write_monolithic(with_roles(pages), f"{folder}/monolithic")
    return read_records(normalise(files, f"{folder}/members"))
