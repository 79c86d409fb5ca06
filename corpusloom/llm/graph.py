"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import scratch


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of each node that has an edge.

    Alternates large-star and small-star steps, which keep every component connected and bring each node to its smallest
    neighbour, until each node is either a centre or has one edge, to a centre: a logarithmic number of rounds in practice. Each step aggregates per node
    with partial sums on the map side and joins the minimum back. The minima are a stored table, so that a node with very many
    neighbours is a skewed join of two plain scans, which adaptive execution splits, and never a collected group. Edges are cut
    from their lineage each round. Nulls are ignored, repeated edges and loops do no harm, and an empty table gives an empty
    result.
    """
    now = scratch.stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")
    while not _stars(now):
        both = now.union(now.select("v", "u"))
        low = scratch.stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = scratch.stored(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "stars")
        low = scratch.stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        near = large.join(low, "u")
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = scratch.stored(small, "edges")
    leaf = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    top = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return leaf.union(top)


def _stars(edges: DataFrame) -> bool:
    """Whether every larger end has one edge and is no smaller end of another."""
    up, down = edges.select(F.col("u").alias("node"), F.lit(1).alias("above"), F.lit(0).alias("below")), edges.select(F.col("v").alias("node"), F.lit(0).alias("above"), F.lit(1).alias("below"))
    ends = up.union(down).groupBy("node").agg(F.sum("above").alias("above"), F.max("below").alias("below"))
    return ends.where("above > 1 or above = 1 and below = 1").isEmpty()
