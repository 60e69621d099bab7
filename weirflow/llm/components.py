"""Connected components of a graph in a table, by turns of large stars and small stars.

Each turn links every node's neighbours to the smallest node around it; after a number of
turns that grows with the logarithm of the longest path, every node is linked to the smallest
node of its component alone. A star's hub may have very many neighbours: smallest neighbours
are found by partial minima, and the join back to a hub's edges can be split, so no task needs
all of a node's edges together. Each turn is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

#: More turns than any graph needs that can be stored.
TURNS = 60


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: each node's neighbours (the larger ones, or the smaller and itself) are linked to the smallest around it."""
    if large:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        around = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = settle(around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    linked = around.join(least, "u")
    if large:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that can be reached), for each node of the edges (columns a and b, long). Edges in either direction, repeated, or from a node to itself are all right."""
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    now = settle(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes = settle(nodes)
    mark = None
    for _ in range(TURNS):
        now = settle(star(settle(star(now, True)), False))
        # a star forest: each node but the smallest has one edge, to the smallest; it stays as it is
        new = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(now, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("component"))
