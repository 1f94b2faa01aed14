"""Exact duplicates by combining whole contents in three stages; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancia.llm.common import stored

# The same text as one blank for every run of blanks, without touching single blanks.
RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def digested(docs: DataFrame, key: str, text: str) -> DataFrame:
    norm = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), RUNS, " ")
    return docs.select(F.col(key).alias("_key"), norm.alias("_norm")).withColumn("_digest", F.unhex(F.sha2("_norm", 256)))


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = 16) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256.

    Rows are equal when their texts are, after each run of ASCII blanks became one blank; null is the empty
    text. Three stages compare digest and whole text: within a map task (the partial aggregate), within a
    salt of a digest (`salts` of them, so a text of a third of all rows is spread out), and among the
    salts' winners. A digest shared by different texts stays apart. The last join, which gives each row its
    group, knows the text by SHA-256 and a second, 64-bit hash only.

    The row with the smallest key stays. Null keys count as rows but win only among themselves; of
    repeated smallest keys every row is kept. Extra columns are not read. No rows give no rows.
    """
    rows = digested(docs, key, text)
    salted = rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    merged = salted.groupBy("_digest", "_salt", "_norm").agg(F.min("_key").alias("_keep"), F.count("*").alias("_n"))
    groups = merged.groupBy("_digest", "_norm").agg(F.min("_keep").alias("_keep"), F.sum("_n").alias("_n"))
    # The text itself goes on only where a digest has several: the hash of the text tells those apart.
    winners = stored(groups.select("_digest", F.xxhash64("_norm").alias("_check"), "_keep", "_n"), "exact-winners")
    members = rows.select("_key", "_digest", F.xxhash64("_norm").alias("_check"))
    found = members.join(winners, ["_digest", "_check"], "left")
    return found.select(
        F.col("_key").alias(key),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_key").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )
