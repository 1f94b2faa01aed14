"""A corpus from raw documents to token files; every stage reads what the one before it wrote.

A document is a row: stages that decide across rows first write their input with a row key and join what
they decide back on it, so null and repeated doc_ids take no other row with them. Stages keep all columns of
their input, whatever their names, but the last, which returns what it read back from the token files. Empty
tables go through and give none.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.llm import decontaminate, mixing, quality, simhash, token_files
from vacancia.llm.common import configured, stored, table
from vacancia.session import scratch_path


def _keyed(docs: DataFrame) -> DataFrame:
    """Written rows: _row (a unique number) and _doc (all columns of the input)."""
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_doc")
    return stored(docs.select(F.monotonically_increasing_id().alias("_row"), whole), "pipeline-rows", "zstd")


def _by_row(keyed: DataFrame) -> DataFrame:
    """doc_id (the row key), text: for operators that tell rows apart by their id."""
    return keyed.select(F.col("_row").alias("doc_id"), F.col("_doc.text").alias("text"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more, by a model learnt from `labels` and the texts of this stage's input."""
    model = quality.fit(*quality.training_bags(docs, table(spark, sf_dir, "labels")))
    return docs.filter(quality.score("text", model) >= 0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates exactly one row: the one with the smallest doc_id, null last."""
    keyed = _keyed(docs)
    found = simhash.near_duplicates(_by_row(keyed)).select(F.col("doc_id").alias("_row"), "component_id")
    ids = keyed.select("_row", F.col("_doc.doc_id").cast("long").alias("_id"))
    rows = stored(found.join(ids, "_row"), "pipeline-near")
    first = F.min(F.struct(F.col("_id").isNull(), "_id", "_row"))
    kept = rows.groupBy("component_id").agg(first.alias("_first")).select("_first._row")
    dropped = stored(rows.select("_row").join(kept, "_row", "left_anti"), "pipeline-dropped")
    return keyed.join(dropped, "_row", "left_anti").select("_doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    keyed = _keyed(docs)
    found = decontaminate.contamination(_by_row(keyed), table(spark, sf_dir, "benchmark"))
    hit = stored(found.filter("contaminated").select(F.col("doc_id").alias("_row")), "pipeline-hit")
    return keyed.join(hit, "_row", "left_anti").select("_doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix reads it: not at all, or up to three times."""
    keyed = _keyed(docs)
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    mixed = mixing.mix(keyed.select("_row", *[F.col(f"_doc.{c}").alias(c) for c in ("doc_id", "source", "text")]), ["_row"])
    read = stored(mixed.select("_row", times.alias("_times")).filter("_times > 0"), "pipeline-mix")
    many = keyed.join(read, "_row").select("_doc", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return many.select("_doc.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, read back from the token files."""
    return token_files.token_files(docs, public_tokenizers.path("word_bpe_49k.json"), scratch_path(spark, "token-files"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", configured(quality_classifier)),
    ("simhash_near_dedup", configured(near_dedup)),
    ("benchmark_decontamination", configured(decontamination)),
    ("source_mixing", configured(mix_sources)),
    ("token_output", configured(token_output)),
]
ORACLE_SQL = None  # a learnt classifier and a tokenizer are not SQL; tests compare each stage with plain code


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
