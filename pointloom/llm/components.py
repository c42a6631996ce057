"""Connected components of an edge list by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stage


def _large(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(low.hint("shuffle_merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them. Edges have u > v."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low.hint("shuffle_merge"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """Map each node of ``edges(u, v)`` (orderable, any direction, repeats and loops allowed; rows with a
    null are ignored) to the smallest node it reaches: ``(node, component)``. Nodes without an edge to
    another node are absent. Every round is a few aggregations and joins on the node; the rounds needed
    grow with the logarithm of the longest path. Each round is staged, so a lost executor costs one round.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    now = stage(pairs.distinct(), "edges")
    mark = None
    while True:
        new = stage(_small(_large(now).distinct()).distinct(), "edges")
        release(now)
        now = new
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(seen) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = tuple(seen)
