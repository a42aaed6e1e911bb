"""Connected components of links by alternating large and small stars, on staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import freed, staged


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b) with a > b. Each node's neighbours (all, or the smaller ones) move to the least of them and itself."""
    ways = edges if not large else edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = staged(ways.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least")), "least")
    met = ways.join(least, "a")  # both sides are plain exchanges, so hubs are split at run time
    if large:
        moved = met.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = met.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("a", F.col("least").alias("b")))
    return moved.where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: each node with a smaller neighbour has that one edge, and nobody's neighbour has one."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 or (out > 0 and in > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(a, b) to (node, component): each linked node but the least of its component, with that least node.

    Cases: links of a node with itself and repeated links say nothing; null ends are left out; no links give no rows.
    """
    edges = links.where("a is not null and b is not null and a <> b")
    edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _settled(edges):
        before, half = edges, staged(_stars(edges, True), "stars")
        edges = staged(_stars(half, False), "edges")
        freed(before, half)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
