"""Connected components by alternating large-star and small-star steps.

Each step is one aggregation (the smallest neighbour of every node) and one equi-join back; no neighbour list is ever
gathered, and the join's other side has one row a node, so a hub's edges can be split over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietwire.llm.scratch import release, stage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (u, v) directed. Connect the chosen neighbours of each u with the smallest node around it."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = links.join(least, "u")
    if large:
        return joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    kept = joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return kept.unionByName(least.filter(F.col("u") != F.col("m")).select(F.col("u").alias("a"), F.col("m").alias("b")))


def _step(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (a, b) with a > b."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    large = _star(both, True).filter("a <> b").distinct()
    down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    return _star(down, False).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); component is its smallest reachable node.

    Self-loops, repeated edges and either direction are allowed; rows with a null end are ignored. Nodes may have any
    orderable type. No edges give no rows.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), (F.col("a") == F.col("b")).alias("same"))
    edges = stage(edges.filter("same = false").drop("same").distinct())
    known = None
    while True:
        # an order-free fingerprint of the edge set: the loop ends when a step changes nothing
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == known or not seen[0]:
            break
        known = seen
        following = stage(_step(edges))
        release(edges)
        edges = following
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
