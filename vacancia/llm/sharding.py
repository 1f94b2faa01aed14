"""Shards of a globally shuffled corpus by a two-pass external shuffle; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancia.llm.common import CLEANUP, stored
from vacancia.session import scratch_path

SHARDS, SEED = 16, 42
BUCKET_BYTES = 16 << 20  # text of a bucket, about; one bucket at a time is in a task's memory
SLICE_BITS = 20  # seeded hashes fall into so many slices; buckets are runs of slices, so their number has a bound
TASKS = 20_000  # partitions of the scatter at most; a task then takes several buckets, one after another
SPARE = 4  # partitions for each bucket below that, so that few tasks get two
OBJECT_HASH = "spark.sql.execution.useObjectHashAggregateExec"


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _slice(rows: list[Column], seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *rows), F.lit(1 << SLICE_BITS)).cast("int")


def bucket_bits(total: int, bucket_bytes: int) -> int:
    """Bits of a bucket's number: buckets are a power of two, so that each is a run of slices."""
    return min(SLICE_BITS, max(0, (max(1, -(-total // bucket_bytes)) - 1).bit_length()))


def first_places(stats: DataFrame, bits: int) -> DataFrame:
    """_bucket, _first: rows in all buckets before. Sums go up to runs of 1,024 buckets first."""
    bucket = F.shiftright("_slice", SLICE_BITS - bits)
    sizes = stats.groupBy(bucket.alias("_bucket")).agg(F.sum("_n").alias("_n")).withColumn("_run", F.shiftright("_bucket", 10))
    ahead = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = sizes.groupBy("_run").agg(F.sum("_n").alias("_n")).select("_run", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_run").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(runs, "_run")
    return placed.select("_bucket", (F.col("_before") + F.col("_inside")).alias("_first"))


def dealt(place: Column, rows: int, shards: int) -> tuple[Column, Column]:
    """Shard and slot of a place of the shuffled order: runs of places, the first ones longer by one."""
    each, longer = divmod(rows, shards)
    edge = longer * (each + 1)
    later = place - F.lit(edge)
    shard = F.when(place < edge, F.floor(place / F.lit(each + 1))).otherwise(longer + F.floor(later / F.lit(max(each, 1))))
    slot = F.when(place < edge, place % F.lit(each + 1)).otherwise(later % F.lit(max(each, 1)))
    return shard.cast("int"), slot.cast("long")


def write_shards(docs: DataFrame, folder: str, rows: list[Column] | None = None, text: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write all rows of `docs` into shard folders and return them read back: doc (all columns), slot, shard.

    First pass: a seeded hash scatters the rows uniformly into buckets of about `bucket_bytes` of text.
    Second pass: each bucket is put together in one task, shuffled there (Spark's `shuffle` is Fisher and
    Yates's) and written. The buckets in a row are one random order of all rows; shard k is its k-th run.
    Counts of shards are at most one apart (the longer ones come first) and slots count up from 0.

    `rows` are columns that tell rows apart, the same in every scan (a file's name and row number); without
    them the rows are written once with a number. They decide the order together with `seed`, so equal rows
    and rows without an id scatter like others, and the same files give the same shards. A row larger than a
    bucket fills one alone. Null texts are stored as they are. Column names of `docs` clash with none, as
    they stay inside `doc`. No rows write no files and give no rows.
    """
    spark = docs.sparkSession
    if rows is None:
        whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc")
        docs = stored(docs.select(F.monotonically_increasing_id().alias("_row"), whole), "shard-rows", "zstd")
        source, body, rows = F.col("doc").getField(text), F.col("doc"), [F.col("_row")]
    else:
        source, body = F.col(f"`{text}`"), F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    sized = docs.select(_slice(rows, seed).alias("_slice"), size_of(source).alias("_size"))
    stats = stored(sized.groupBy("_slice").agg(F.count("*").alias("_n"), F.sum("_size").alias("_bytes")), "shard-slices")
    total = stats.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("_bytes"), F.lit(0)).alias("b")).first()
    bits = bucket_bits(total["b"], bucket_bytes)
    # At most 2**SLICE_BITS buckets, whatever the input: the table of their first places can be broadcast.
    first = F.broadcast(stored(first_places(stats, bits), "shard-buckets"))

    order = F.xxhash64(F.lit(seed + 1), *rows)
    scattered = docs.select(F.shiftright(_slice(rows, seed), SLICE_BITS - bits).alias("_bucket"), order.alias("_order"), body.alias("doc"))
    scattered = scattered.repartition(min(TASKS, SPARE << bits), "_bucket").sortWithinPartitions("_bucket", "_order")
    buckets = scattered.groupBy("_bucket").agg(F.collect_list("doc").alias("_docs"))
    mixed = buckets.select("_bucket", F.posexplode(F.shuffle("_docs", seed)).alias("_at", "doc")).join(first, "_bucket")
    shard, slot = dealt(F.col("_first") + F.col("_at"), total["n"], shards)
    out = mixed.select("doc", slot.alias("slot"), shard.alias("shard"))
    before = {c: spark.conf.get(c) for c in (OBJECT_HASH, CLEANUP)}
    spark.conf.set(OBJECT_HASH, "false")  # one bucket in memory after another, in the order of the sort
    spark.conf.set(CLEANUP, "true")
    try:
        out.write.partitionBy("shard").option("compression", "zstd").parquet(folder)
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)
    return spark.read.schema(out.schema).parquet(folder)


def shard_documents(docs: DataFrame, rows: list[Column] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row, from the files of its shard.

    `size` is the bytes of the text plus one (null: one), text_crc32 that of the text's UTF-8 (null: of
    nothing). The law is `rows`, under which no shard is foreseen to grow, so grown_shard is null.
    """
    found = write_shards(docs, scratch_path(docs.sparkSession, "shards"), rows)
    text = F.col("doc.text")
    return found.select(
        F.col("doc.doc_id").alias("doc_id"),
        size_of(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
