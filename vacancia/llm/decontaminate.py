"""Benchmark passages in documents through a positional inverted index; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancia.llm.common import ascii_lower, stored

TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SEEDS = 2  # rarest terms whose lists are intersected before a document's other lists are read
END = ""  # no term is empty: at this one the index keeps how many terms a document has


def terms(text: str) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TERM), F.lit(0))


def windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """item, phrase (array of terms): all runs of `width` terms of an item, or its only run if it has fewer."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), terms("text").alias("t")).filter(F.size("t") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("t") - width + 1, F.lit(1)))
    return rows.select("item", F.explode(F.transform(starts, lambda i: F.slice("t", i, width))).alias("phrase")).distinct()


def build_index(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """Stored postings doc (struct of doc_id and a hash of the text), pos, term.

    Only terms of `phrases` (column phrase) are kept, as no other can match; every document also has END
    at the place behind its last term.
    """
    vocabulary = phrases.select(F.explode("phrase").alias("term")).union(phrases.sparkSession.range(1).select(F.lit(END).alias("term"))).distinct()
    doc = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"))
    rows = docs.select("doc_id", "text").select(doc.alias("doc"), F.posexplode(F.concat(terms("text"), F.array(F.lit(END)))).alias("pos", "term"))
    return stored(rows.join(stored(vocabulary, "index-terms"), "term"), "index")


def _ranked_terms(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """key, size, off, term, rank (0: the rarest term) of phrases all of whose terms occur."""
    counts = index.filter(F.col("term") != END).groupBy("term").agg(F.count("*").alias("n"))
    keyed = phrases.select(F.concat_ws(" ", "phrase").alias("key"), "phrase").distinct()
    parts = keyed.select("key", F.size("phrase").alias("size"), F.posexplode("phrase").alias("off", "term"))
    parts = parts.join(stored(counts, "index-counts"), "term")
    each = Window.partitionBy("key")
    parts = parts.withColumn("there", F.count("*").over(each)).filter("there = size")
    rank = F.row_number().over(each.orderBy("n", "off")) - 1
    return stored(parts.select("key", "size", "off", "term", rank.alias("rank")), "index-phrases")


def _lists(index: DataFrame, parts: DataFrame, rank: int) -> DataFrame:
    """Postings of the terms that have this rank in some phrase.

    The terms are a table of their own, so Spark knows its size: small, it is broadcast and the index is not
    moved; otherwise a frequent term's postings are dealt out anew as skew.
    """
    wanted = stored(parts.filter(F.col("rank") == rank).select("term").distinct(), "index-seeds")
    return index.join(wanted, "term", "left_semi")


def phrase_matches(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """doc, key (the phrase's terms, blank between), start, size: every place where a phrase stands.

    The list of a phrase's rarest term, moved by the term's place in the phrase, gives candidate starts; the
    next rarest terms' lists, moved likewise, are intersected with them; then, in documents that still
    have a candidate, the lists of all other terms.
    """
    parts = _ranked_terms(index, phrases)
    seed = parts.filter("rank = 0").select("key", "size", "off", "term")
    found = _lists(index, parts, 0).join(seed, "term").select("doc", "key", "size", (F.col("pos") - F.col("off")).alias("start")).filter("start >= 0")
    for rank in range(1, SEEDS):
        found = stored(found, "index-candidates")
        with_next = found.filter(F.col("size") > rank).join(parts.filter(F.col("rank") == rank).select("key", "off", "term"), "key")
        kept = with_next.withColumn("pos", F.col("start") + F.col("off")).join(_lists(index, parts, rank), ["doc", "pos", "term"], "left_semi")
        found = kept.select("doc", "key", "size", "start").union(found.filter(F.col("size") <= rank))
    found = stored(found.distinct(), "index-candidates")
    lists = index.join(found.filter(F.col("size") > SEEDS).select("doc").distinct(), "doc", "left_semi")
    others = found.join(parts.filter(F.col("rank") >= SEEDS).select("key", "off", "term"), "key").withColumn("pos", F.col("start") + F.col("off"))
    met = others.join(lists, ["doc", "pos", "term"]).groupBy("doc", "key", "size", "start").agg(F.countDistinct("off").alias("n"))
    whole = met.filter(F.col("n") == F.col("size") - SEEDS).select("doc", "key", "size", "start")
    return whole.union(found.filter(F.col("size") <= SEEDS).select("doc", "key", "size", "start"))


def proximity_matches(index: DataFrame, phrases: DataFrame, slop: int) -> DataFrame:
    """doc, key, start: where all different terms of a phrase, in any order, lie within its size plus `slop` places.

    `start` is the first place of such a stretch, counted at each posting of the phrase's rarest term. The
    other terms' postings are met in slices of the stretch's length, so a posting is compared with near ones
    only; a stretch's postings are collected, which its length bounds.
    """
    parts = _ranked_terms(index, phrases).withColumn("reach", F.col("size") + slop)
    first = parts.groupBy("key", "term", "reach").agg(F.min("rank").alias("rank"))
    kinds = first.groupBy("key").agg(F.count("*").alias("kinds"))
    seeds = _lists(index, parts, 0).join(first.filter("rank = 0").select("key", "term", "reach"), "term").select("doc", "key", "reach", F.col("pos").alias("at"))
    slices = F.explode(F.array(*[F.floor(F.col("at") / F.col("reach")) + i for i in (-1, 0, 1)]))
    wanted = seeds.withColumn("slice", slices).join(first.select("key", "term"), "key")
    reaches = first.select("term", "reach").distinct()
    lists = index.join(reaches, "term").withColumn("slice", F.floor(F.col("pos") / F.col("reach")))
    near = wanted.join(lists, ["doc", "term", "reach", "slice"]).filter(F.abs(F.col("pos") - F.col("at")) < F.col("reach"))
    held = near.groupBy("doc", "key", "reach", "at").agg(F.collect_set(F.struct("pos", "term")).alias("near")).join(kinds, "key")
    places = F.array_sort(F.transform("near", lambda x: x["pos"]))

    def holds(start: Column) -> Column:
        inside = F.filter("near", lambda x: (x["pos"] >= start) & (x["pos"] < start + F.col("reach")))
        here = (start <= F.col("at")) & (start > F.col("at") - F.col("reach"))
        return here & (F.size(F.array_distinct(F.transform(inside, lambda x: x["term"]))) == F.col("kinds"))

    starts = F.filter(places, holds)
    return held.select("doc", "key", F.get(starts, F.lit(0)).alias("start")).filter("start IS NOT NULL").distinct()


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per row of `docs`.

    A-Z count as a-z; words are runs of letters and digits of ASCII and of all other characters. A word is hit
    inside any place where `width` consecutive words of an item stand (all words of a shorter item).

    Null texts, of documents or items, have no words; an item without words never occurs. A null item_id is
    the id "", repeated ids are one item. Null doc_ids are documents like others, and so are rows that
    repeat an id: they are told apart by their texts. Extra columns are not read. An empty `items` hits nothing.
    """
    named = windows(items, width)
    index = build_index(docs, named)
    matches = stored(phrase_matches(index, named), "index-matches")
    covered = matches.select("doc", "start", "size").distinct().select("doc", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("pos"))
    hits = covered.distinct().groupBy("doc").agg(F.count("*").alias("n_hit"))
    of_items = named.select("item", F.concat_ws(" ", "phrase").alias("key")).join(matches.select("doc", "key").distinct(), "key")
    items_of = of_items.select("doc", "item").distinct().groupBy("doc").agg(F.sort_array(F.collect_list("item")).alias("items"))
    marks = stored(hits.join(items_of, "doc"), "index-hits")
    sizes = index.filter(F.col("term") == END).select("doc", F.col("pos").cast("long").alias("n_words"))
    found = sizes.join(marks, "doc", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return found.select(
        F.col("doc.doc_id").alias("doc_id"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
