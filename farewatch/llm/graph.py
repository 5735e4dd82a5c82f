"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from farewatch.llm.common import save


def _smallest_neighbour(edges: DataFrame) -> DataFrame:
    """(v, m): the smallest of a node and its neighbours."""
    return edges.groupBy("v").agg(F.least("v", F.min("u")).alias("m"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of the edges (v, u).

    A step hangs every node's neighbours onto its smallest neighbour: the larger
    ones (large star), then the rest (small star).  The edges end as stars around
    each component's smallest node, in about log(n) rounds.  A node's
    neighbours are never gathered in one task; only their minimum is taken, by
    partial aggregation.  Self-loops and repeated edges are allowed; nodes
    without an edge to another node do not appear.
    """
    edges = save(edges.where("v <> u").select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u")).distinct(), "cc")
    before = None
    while True:
        both = _both_ways(edges)
        large = (both.join(_smallest_neighbour(both), "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
                 .where("v <> u").distinct())
        # Small star: every remaining edge points from v to a smaller u.
        small = large.join(large.groupBy("v").agg(F.min("u").alias("m")), "v")
        edges = save(small.select("v", F.col("m").alias("u"))
                     .unionByName(small.select(F.col("u").alias("v"), F.col("m").alias("u")))
                     .where("v <> u").distinct(), "cc")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node")).distinct()
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))
