"""Connected components of a graph of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfseek.sources.tables import stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least node around it."""
    near = _both(edges)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return near.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).filter("a <> b")


def _settled(edges: DataFrame) -> bool:
    """Whether every node is linked to one root alone, and roots to no smaller node."""
    ends = edges.select(F.col("a").alias("node"), F.lit(0).alias("below")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(1).alias("below")))
    per_node = ends.groupBy("node").agg(F.sum("below").alias("below"), F.count("*").alias("n"))
    return per_node.filter("below > 1 or (below = 1 and n > 1)").isEmpty()


def connected(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) of every node in ``a``, ``b`` links.

    Each round is written to the shared folder. Rows are linked through minima
    per node, so that no neighbourhood is gathered.
    """
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                   .filter("a <> b").distinct(), "links")
    while not _settled(edges):
        edges = stored(_small_star(_large_star(edges)).distinct(), "star")
    roots = edges.select("a").distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        roots.select(F.col("a").alias("node"), F.col("a").alias("root")))
