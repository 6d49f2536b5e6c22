"""Connected components of an edge table, by alternating large-star and small-star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every larger neighbour of a node moves to the smallest node around.  Small: every smaller one does."""
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    sides = edges.unionByName(turned) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    if large:
        moved = sides.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = sides.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of `edges` (u, v): label is the smallest node of its component.  Each round is
    written to the shared folder; the loop ends when a round changes nothing, after O(log^2 n) rounds.  A hub meets its
    smallest neighbour by an equality join, which Spark splits when one side is skewed."""
    edges = written(edges.where("u <> v").distinct(), "edges")
    state = _state(edges)
    while True:
        edges = written(_stars(_stars(edges, True), False), "edges")
        state, before = _state(edges), state
        if state == before:
            roots = edges.select(F.col("v").alias("node")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots.withColumn("label", F.col("node")))
