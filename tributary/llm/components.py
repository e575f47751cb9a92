"""Connected components by alternating stars: joins and sums over edges, a few rounds, nothing gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.columns import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Neighbours above a node move to the least of its neighbours and itself."""
    both = _both_ways(edges)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it move to the least of these."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(least, "b")
    moved = joined.select(F.col("m").alias("a"), F.col("a").alias("b")).union(least.select(F.col("m").alias("a"), "b"))
    return moved.filter(F.col("a") != F.col("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node that it is connected with, of every node in an edge (``a``, ``b``)."""
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct()
    pairs = written(pairs, "edges")
    before, now = None, _mark(pairs)
    while now != before:
        pairs = written(_small_star(_large_star(pairs)), "edges")
        before, now = now, _mark(pairs)
    roots = pairs.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("root"))
    return pairs.select(F.col("b").alias("node"), F.col("a").alias("root")).union(roots)
