"""Connected components of an edge table by alternating stars, without any collection of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def _unsettled(edges: DataFrame) -> bool:
    """Whether a node still hangs below two others, or below one that hangs itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    nodes = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return not nodes.where("below > 1 OR (below = 1 AND above = 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b longs); the component is its smallest node.

    Each round hangs the larger neighbours of a node, then the smaller ones, below the smallest node in sight; rounds
    needed grow with the logarithm of the longest path. A node with very many neighbours is one of small number after
    the first steps: its neighbours meet it by an aggregate with map-side combining and an equi-join, which adaptive
    execution splits; a window only holds the few smaller neighbours of a node. Self links, repeated and null links are
    ignored; no edges give an empty table.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    smaller = Window.partitionBy("u")
    while _unsettled(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # (u, v) becomes (v, m) with the smallest m below u, and u keeps m
        seen = large.withColumn("m", F.min("v").over(smaller))
        hung = F.array(F.struct(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")),
                       F.struct("u", F.col("m").alias("v")))
        e = cut(seen.select(F.explode(hung).alias("_e")).select("_e.u", "_e.v").where("u > v").distinct())
    hubs = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(hubs)
