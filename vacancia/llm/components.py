"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancia.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest neighbour (or the node itself)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_a"), F.least("a", "m").alias("m"))
    moved = both.filter("b > a").join(least, F.col("a") == F.col("_a"))
    return moved.select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them. Edges go from the smaller `a` to `b`."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least.select(F.col("b").alias("_b"), "m"), F.col("b") == F.col("_b"))
    return moved.filter("a > m").select(F.col("m").alias("a"), F.col("a").alias("b")).union(least.select(F.col("m").alias("a"), "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of `links` (a, b) that has another as its root.

    Rounds are written to the shared folder and end when the edges no longer change; the driver sees two
    numbers a round. Links in either direction, repeated, or of a node to itself are allowed; no links give
    no rows.
    """
    pairs = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, seen = stored(pairs, "links"), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or now[0] == 0:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = now
        edges = stored(_small_star(stored(_large_star(edges), "large-star")), "small-star")
