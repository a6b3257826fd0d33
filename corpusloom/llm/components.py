"""Connected components whose hubs may have any number of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tables import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for links (u, v); a component is named by its least node.

    In every round a node and its label both take the least label found across the node's links, so whole trees
    hook on to smaller ones, and then the label of the label: rounds grow with the logarithm of the longest path.
    Minima combine map-side. The joins read tables written to the checkpoint folder, so both sides are shuffled
    by the join itself and Spark may split a hub's rows.
    """
    ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    both = stored(edges.where("u <> v").select(F.inline(ways)).distinct())
    labels = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("label")))
    while True:
        across = both.join(labels.select(F.col("u").alias("v"), F.col("label").alias("far")), "v").join(labels, "u")
        across = across.where("far < label").select(F.explode(F.array("u", "label")).alias("u"), "far")
        hooks = stored(across.groupBy("u").agg(F.min("far").alias("far")))
        lower = stored(labels.join(hooks, "u", "left").select("u", F.least("label", "far").alias("label")))
        parent = lower.select(F.col("u").alias("label"), F.col("label").alias("top"))
        jumped = stored(lower.join(parent, "label").select("u", F.col("top").alias("label"), F.col("label").alias("old")))
        labels = jumped.select("u", "label")
        if hooks.isEmpty() and jumped.where("label <> old").isEmpty():
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))
