"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.texts import stage


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and a sum of their hashes: equal only for equal sets."""
    part = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(part)).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) but the roots: the smallest node that links reach.

    Each round joins all larger neighbours of a node to the smallest one, then
    all smaller ones; the number of edges never grows, and rounds grow with the
    logarithm of the longest path.  Minima are combined before the exchange, so
    a node with very many links is no burden.  Each round is written, and the
    loop ends when a round changes nothing.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    edges = stage(links.select(a.alias("a"), b.alias("b")).where("a <> b").distinct(), "edges")
    before = _mark(edges)
    while before[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        moved = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(moved.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
