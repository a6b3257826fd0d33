"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import pinned

MAX_ROUNDS = 60


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least node of its neighbourhood."""
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = near.where(F.col("v") > F.col("u")).join(least, "u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u")
    smaller = linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return smaller.unionByName(own).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges (u, v); the component is its least node.

    Neighbourhood minima are map-side aggregates, so a node with very many edges is no hot group.
    Each round is written to the shared checkpoint folder; the number of rounds grows with the
    logarithm of the longest path.
    """
    given = pinned(edges.select("u", "v").distinct())
    nodes = given.select(F.col("u").alias("node")).unionByName(given.select(F.col("v").alias("node"))).distinct()
    current = given.where("u <> v")
    mark = None
    for _ in range(MAX_ROUNDS):
        current = pinned(_small_star(_large_star(current)))
        stats = current.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("digest"),
        ).first()
        if mark == (stats["n"], stats["digest"]):
            break
        mark = (stats["n"], stats["digest"])
    else:
        raise RuntimeError("components did not settle")
    labels = current.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(labels, nodes["node"] == labels["u"], "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
