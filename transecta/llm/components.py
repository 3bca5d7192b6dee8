"""Connected components of an edge table by alternating stars, without bringing edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node, and the node, points to the smallest of its neighbourhood."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    larger = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("a"))
    return larger.join(least, "a").select(F.col("u").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node's smaller neighbours, and the node, point to the smallest of them. Edges go from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node of its component, for every node of edges(a, b) that is not its own root.

    Nodes can be of any orderable type; repeated edges, loops and either direction are allowed.
    Each round is a written table, and the rounds end when a round changes no edge, after a
    number that grows with the logarithm of the longest path.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).alias("mark")
    before = now.agg(mark).first()["mark"]
    while before[0]:
        now = written(_small_star(_large_star(now)), "edges")
        after = now.agg(mark).first()["mark"]
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
