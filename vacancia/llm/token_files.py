"""Token ids as compressed binary files in document order, and the way back.

A file: MAGIC, version, number of ids in the vocabulary, bytes of the packed code lengths, those lengths;
then blocks. A block is read alone: numbers of documents, ids, checkpoints and payload bytes, and flags;
each document's id (and whether it has one) and number of ids; bit offsets of every STEP-th id; the bits. A
document of more than BLOCK_IDS ids is cut into blocks of its own, a chain, whose flags say so. All numbers
are little-endian. A table of blocks (path, place, offset, chain, length, ids) is the index.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacancia.llm import huffman
from vacancia.llm.common import offsets_by, stored
from vacancia.llm.tokenizing import encoder, vocabulary_size
from vacancia.llm.warc import located

MAGIC, VERSION = b"TOKH", 2
BLOCK_IDS = 1 << 18  # a block is closed by the document that reaches so many; a longer document is cut
COUNTERS = 8  # tasks that add up counts of ids
DECODE_BYTES = 4 << 20  # bytes of blocks a decoding task reads, about
FROM_BEFORE, GOES_ON = 1, 2  # flags of a block: its document began in the block before, goes on in the next
BLOCKS = "path string, place long, offset long, chain long, length long, n_ids long"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def encoded(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int) -> DataFrame:
    """place, doc_id, ids (little-endian unsigned 32-bit, end id last), stored in ascending doc_id order.

    Rows of one id are ordered by a hash of their text, equal ones by where they were read, so nothing that
    occurs often has to stay in one partition. Places number the rows of the sorted partitions upwards with
    gaps between partitions. Each task ends with a row that holds its count of every id and nothing else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end, total = encoder(tokenizer).ids, struct.pack("<I", end_id), np.zeros(vocabulary, np.int64)
        for batch in batches:
            packed = [ids(text.as_py()) + end for text in batch.column("text")]
            total += np.bincount(np.frombuffer(b"".join(packed), "<u4"), minlength=vocabulary)
            none = pa.nulls(len(packed), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("doc_id"), pa.array(packed, pa.binary()), none], names)
        if total.any():
            none, counts = pa.nulls(1, pa.int64()), pa.array([total.astype("<i8").tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([none, none, pa.nulls(1, pa.binary()), counts], names)

    names = ["place", "doc_id", "ids", "counts"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"_tie": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    order = ["doc_id", "_tie", "_row"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    return stored(placed.select("place", "doc_id", "text").mapInArrow(run, "place long, doc_id long, ids binary, counts binary"), "token-ids", "zstd")


def id_counts(encodings: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs, from the counts of the encoding tasks.

    They are added up by COUNTERS tasks; the driver gets one array of the vocabulary's size from each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for row in batch.column("counts"):
                total += np.frombuffer(row.as_py(), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], ["counts"])

    tasks = encodings.filter("counts IS NOT NULL").select("counts").repartition(COUNTERS)
    return sum((np.frombuffer(r["counts"], "<i8") for r in tasks.mapInArrow(run, "counts binary").collect()), np.zeros(vocabulary, np.int64))


def write_files(ids: DataFrame, lengths: np.ndarray, folder: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write each run of neighbouring places as a file; returns the BLOCKS table. `block_ids` bounds a block of one document."""
    coded = lengths.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = located(folder)
        store.create_dir(base, recursive=True)
        sizes = np.frombuffer(coded, np.uint8)
        codes, packed = huffman.canonical(sizes), zlib.compress(coded)
        out = path = last = None
        offset, held, rows = 0, [], []

        def put(docs: list[tuple], chain: int, flags: int = 0) -> None:
            nonlocal offset
            data, n = block(docs, codes, sizes, flags)
            out.write(data)
            rows.append({"path": path, "place": docs[0][0], "offset": offset, "chain": chain, "length": len(data), "n_ids": n})
            offset += len(data)

        def flush() -> None:
            put(held, offset)
            held.clear()

        def cut(place: int, doc_id: int | None, data: bytes) -> None:
            chain, size = offset, 4 * block_ids
            for at in range(0, len(data), size):
                put([(place, doc_id, data[at : at + size])], chain, FROM_BEFORE * (at > 0) | GOES_ON * (at + size < len(data)))

        waiting = 0
        for batch in batches:
            for place, doc_id, data in zip(*(batch.column(c).to_pylist() for c in ("place", "doc_id", "ids")), strict=True):
                if out is None or place != last + 1:
                    if out is not None:
                        if held:
                            flush()
                        out.close()
                    name = f"{uuid.uuid4().hex}.tokh"
                    path, out, waiting = f"{folder}/{name}", store.open_output_stream(f"{base}/{name}"), 0
                    head = MAGIC + struct.pack("<III", VERSION, len(coded), len(packed)) + packed
                    out.write(head)
                    offset = len(head)
                last = place
                if len(data) > 4 * block_ids:
                    if held:
                        flush()
                    cut(place, doc_id, data)
                    waiting = 0
                    continue
                held.append((place, doc_id, data))
                waiting += len(data) // 4
                if waiting >= block_ids:
                    flush()
                    waiting = 0
            if rows and not held:
                yield pa.RecordBatch.from_pylist(rows)
                rows.clear()
        if held:
            flush()
        if out is not None:
            out.close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows)

    return stored(ids.select("place", "doc_id", "ids").mapInArrow(run, BLOCKS), "token-blocks")


def block(docs: list[tuple[int, int | None, bytes]], codes: np.ndarray, lengths: np.ndarray, flags: int = 0) -> tuple[bytes, int]:
    ids = np.frombuffer(b"".join(d[2] for d in docs), "<u4")
    bits, checkpoints = huffman.pack(ids, codes, lengths)
    named = np.array([d[1] or 0 for d in docs], "<i8").tobytes() + bytes(d[1] is not None for d in docs)
    sizes = np.array([len(d[2]) // 4 for d in docs], "<u4").tobytes()
    head = struct.pack("<IIIII", len(docs), len(ids), len(checkpoints), len(bits), flags)
    return head + named + sizes + checkpoints.astype("<u4").tobytes() + bits, len(ids)


def read_block(data: bytes, table: tuple) -> tuple[int, Iterator[tuple[int | None, np.ndarray]]]:
    """Flags of a block; doc_id and ids of each of its documents."""
    n_docs, n_ids, n_checks, n_bytes, flags = struct.unpack_from("<IIIII", data)
    at = 20
    names, at = np.frombuffer(data, "<i8", n_docs, at), at + 8 * n_docs
    there, at = data[at : at + n_docs], at + n_docs
    sizes, at = np.frombuffer(data, "<u4", n_docs, at), at + 4 * n_docs
    checks, at = np.frombuffer(data, "<u4", n_checks, at), at + 4 * n_checks
    ids = huffman.unpack(data[at : at + n_bytes], n_ids, checks, table)
    ends = np.cumsum(sizes, dtype=np.int64)
    docs = zip(names.tolist(), there, sizes.tolist(), ends.tolist(), strict=True)
    return flags, ((name if known else None, ids[end - size : end]) for name, known, size, end in docs)


def with_starts(blocks: DataFrame) -> DataFrame:
    """`start`: ids of all blocks before, by place. Sums go up to files first, so no task sees all blocks."""
    before = Window.partitionBy("path").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    first = blocks.groupBy("path").agg(F.min("place").alias("_first"), F.sum("n_ids").alias("_ids"))
    ahead = offsets_by(first, [], "_first", "_ids", "_before").join(first.select("path", "_first"), "_first")
    inside = F.coalesce(F.sum("n_ids").over(before), F.lit(0))
    return blocks.withColumn("_inside", inside).join(ahead, "path").withColumn("start", F.col("_before") + F.col("_inside"))


def read_documents(index: DataFrame, decode_bytes: int = DECODE_BYTES) -> DataFrame:
    """DOCS rows read from the files of a stored BLOCKS table with `start`.

    The bytes of the blocks, not the size of this table, say how many tasks decode. The blocks of a chain go
    to one task in order, which holds one block at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = file = table = begun = None
        for batch in batches:
            for at in batch.to_pylist():
                if at["path"] != last:
                    if file is not None:
                        file.close()
                    store, path = located(at["path"])
                    last, file = at["path"], store.open_input_file(path)
                    table = huffman.decoding_table(file_lengths(file))
                file.seek(at["offset"])
                start, rows = at["start"], []
                flags, docs = read_block(file.read(at["length"]), table)
                for doc_id, ids in docs:
                    first, n, crc = begun if flags & FROM_BEFORE else (start, 0, 0)
                    rows.append((doc_id, first, n + len(ids), zlib.crc32(ids.astype("<u4").data, crc)))
                    start += len(ids)
                if flags & GOES_ON:
                    begun, rows = rows[0][1:], []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    size = index.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    near = F.floor(F.col("chain") / decode_bytes)  # neighbours in a file stay together
    dealt = index.repartition(max(1, -(-size // decode_bytes)), "path", near).sortWithinPartitions("path", "offset")
    return dealt.select("path", "offset", "length", "start").mapInArrow(run, DOCS)


def file_lengths(file) -> np.ndarray:
    file.seek(0)
    head = file.read(16)
    version, size, packed = struct.unpack_from("<III", head, 4)
    if head[:4] != MAGIC or version != VERSION:
        raise ValueError("not a token file of this version")
    lengths = np.frombuffer(zlib.decompress(file.read(packed)), np.uint8)
    if len(lengths) != size:
        raise ValueError("token file has a broken header")
    return lengths


def token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, vocabulary: int | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write the ids of all documents, each followed by `end_id`, and read them back.

    Returns per row, from the files: doc_id, start (ids of all documents before it), n_tokens (with the end
    id), ids_crc32. `vocabulary` is above every id; unless given it is that of the tokenizer file. Code
    lengths come from the counts over all documents.

    A null text has the end id only. Null doc_ids come first and are read back as null; rows that repeat an
    id follow each other in the order of their texts' hashes. A text of any length is written in blocks of
    `block_ids` ids. Extra columns are not read. No rows write no files and give no rows.
    """
    vocabulary = max(vocabulary_size(tokenizer) if vocabulary is None else vocabulary, end_id + 1)
    encodings = encoded(docs, tokenizer, end_id, vocabulary)
    lengths = huffman.code_lengths(id_counts(encodings, vocabulary), max(huffman.MAX_BITS, (vocabulary - 1).bit_length()))
    blocks = write_files(encodings.filter("place IS NOT NULL"), lengths, folder, block_ids)
    return read_documents(stored(with_starts(blocks), "token-index"))
