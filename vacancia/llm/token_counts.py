"""Token counts behind a cache of content digests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.llm.common import stored
from vacancia.llm.tokenizing import encoder, version

CACHE_SCHEMA = "tokenizer binary, digest binary, n_tokens long"


def cached(spark: SparkSession, cache: str, tokenizer: bytes) -> DataFrame | None:
    """Stored counts of one tokenizer version, one row per digest; None before the first append."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == F.lit(tokenizer))
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_misses(misses: DataFrame, tokenizer: str) -> DataFrame:
    """digest, n_tokens of (digest, text), each text encoded whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(tokenizer).ids
        for batch in batches:
            counts = [len(ids(text.as_py())) // 4 for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return misses.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def token_counts(docs: DataFrame, tokenizer: str, cache: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens), one row per input row.

    `tokenizer` is a file of the tokenizers or sentencepiece library; nothing is added, cut or padded. The
    content is normalised only as far as no count can change: null becomes the empty text. `cache` is a
    Parquet folder of (tokenizer digest, content digest, count): known contents are joined to it, each
    distinct unknown one is encoded once and appended. Rows appended twice by concurrent runs are equal and
    count once. A changed tokenizer file has another digest, so its counts are never mixed with older ones.

    Null and repeated doc_ids are kept as they are; extra columns are not read; no rows give no rows.
    """
    spark, name = docs.sparkSession, version(tokenizer)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    contents = rows.groupBy("digest").agg(F.first("text").alias("text"))
    known = cached(spark, cache, name)
    misses = contents if known is None else contents.join(known, "digest", "left_anti")
    count_misses(misses, tokenizer).select(F.lit(name).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    counts = stored(cached(spark, cache, name), "token-counts")
    members = rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return members.join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
