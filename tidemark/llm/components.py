"""Connected components by large stars and small stars, on edges that never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's larger (or smaller) neighbours are linked to its smallest neighbour.

    The smallest neighbour is a partial aggregate, joined back; a node of many links is split
    by the engine's skew join, as one side has a single row for it.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    linked = both.join(least, "a")
    if large:
        moved = linked.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = linked.where("b < a and b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.where("least < a").select("a", F.col("least").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): component is its smallest node.

    Each round is written to the shared folder, so a lost executor costs one round at most.
    Rounds grow with the logarithm of the number of nodes.
    """
    def sign(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0])

    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "edges")
    seen = sign(edges)
    while seen[0]:
        older, edges = edges, materialize(_star(_star(edges, large=True), large=False), "edges")
        before, seen = seen, sign(edges)
        discard(older)
        if before == seen:
            break
    # All that is left are stars around the smallest node of each component.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
