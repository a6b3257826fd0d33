"""Reciprocal rank fusion of ranked channels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def tagged_union(channels: list[DataFrame]) -> DataFrame:
    """Union of ranked channels (query_id, item_id, position), numbered in the given order."""
    tagged = [c.withColumn("channel", F.lit(no)) for no, c in enumerate(channels, 1)]
    return reduce(DataFrame.unionByName, tagged)


def reciprocal_rank_fusion(ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """Fuse (query_id, channel, item_id, position) into (query_id, item_id, score, rank).

    An item counts once per channel, at its first position; ranks count distinct items. Ties go to
    the item seen first, channel 1 before channel 2. Channels are top-k lists, so the groups are
    small whatever the corpus size.
    """
    if k < 0:
        raise ValueError("invalid_rrf_k")
    first = ranked.groupBy("query_id", "channel", "item_id").agg(F.min("position").alias("position"))
    in_channel = Window.partitionBy("query_id", "channel").orderBy("position", "item_id")
    distinct = first.withColumn("channel_rank", F.row_number().over(in_channel))
    fused = distinct.groupBy("query_id", "item_id").agg(
        F.sum(1.0 / (k + F.col("channel_rank"))).alias("raw"),
        F.min(F.struct("channel", "channel_rank")).alias("first_seen"),
    )
    scored = fused.withColumn("score", F.round("raw", 8))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "first_seen", "item_id")
    return scored.select(
        "query_id", "item_id", "score", F.row_number().over(best).alias("rank")
    )
