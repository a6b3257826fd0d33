"""Maximal marginal relevance: the first picks of the greedy order, exactly."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from corpusloom.functions import text as T
from corpusloom.session import pinned

LAMBDA = 0.7
GROUP_LIMIT = 5_000


def _jaccard(left: frozenset, right: frozenset) -> float:
    if not left and not right:
        return 1.0
    return len(left & right) / len(left | right)


def greedy_order(relevance: list[float], token_sets: list[frozenset], picks: int, lam: float) -> list[int]:
    """Positions in greedy order; ties go to the earlier position. Each pick costs one pass."""
    left = np.ones(len(relevance), dtype=bool)
    scores = np.array(relevance, dtype=np.float64)
    redundancy = np.zeros(len(relevance))
    order: list[int] = []
    while len(order) < min(picks, len(relevance)):
        value = scores if not order else lam * scores - (1 - lam) * redundancy
        best = int(np.argmax(np.where(left, value, -np.inf)))
        order.append(best)
        left[best] = False
        for position in np.flatnonzero(left):
            redundancy[position] = max(
                redundancy[position], _jaccard(token_sets[position], token_sets[best])
            )
    return order


def _small_groups(claims: DataFrame, picks: str, lam: float) -> DataFrame:
    """Groups of bounded size as one row each; a batch of many groups goes to Python at once."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def order_groups(relevance: pd.Series, tokens: pd.Series, wanted: pd.Series) -> pd.Series:
        groups = zip(relevance, tokens, wanted, strict=True)
        return pd.Series(
            [greedy_order(list(r), [frozenset(t) for t in sets], int(n), lam) for r, sets, n in groups]
        )

    row = F.struct("seq", "claim_id", "relevance", "tokens")
    grouped = claims.groupBy("query_id", "page_id").agg(
        F.array_sort(F.collect_list(row)).alias("rows"), F.max(picks).alias("wanted")
    )
    order = order_groups(
        F.transform("rows", lambda r: r["relevance"]), F.transform("rows", lambda r: r["tokens"]), "wanted"
    )
    placed = grouped.select(
        "query_id",
        "page_id",
        F.transform("rows", lambda r: F.struct(r["claim_id"], r["relevance"])).alias("rows"),
        F.posexplode(order).alias("place", "position"),
    )
    chosen = F.element_at("rows", F.col("position") + 1)
    return placed.select(
        "query_id",
        "page_id",
        chosen["claim_id"].alias("claim_id"),
        chosen["relevance"].alias("relevance"),
        (F.col("place") + 1).cast("long").alias("pick"),
    )


def _large_groups(claims: DataFrame, picks: str, lam: float) -> DataFrame:
    """One distributed round per pick: a map-side arg-min of the negated value, then a join of the pick to its group."""
    key = ["query_id", "page_id"]
    state = claims.withColumn("redundancy", F.lit(None).cast("double"))
    rounds = claims.agg(F.max(picks)).first()[0] or 0
    chosen = None
    for number in range(1, rounds + 1):
        marginal = lam * F.col("relevance") - (1 - lam) * F.col("redundancy")
        value = F.when(F.col("redundancy").isNull(), F.col("relevance")).otherwise(marginal)
        open_rows = state.where(F.col(picks) >= number)
        best = pinned(
            open_rows.groupBy(*key)
            .agg(
                F.min_by(
                    F.struct("claim_id", "relevance", "tokens"), F.struct(-value, "seq", "claim_id")
                ).alias("b")
            )
            .select(
                *key,
                F.col("b.claim_id").alias("claim_id"),
                F.col("b.relevance").alias("relevance"),
                F.col("b.tokens").alias("picked_tokens"),
                F.lit(number).cast("long").alias("pick"),
            )
        )
        chosen = best if chosen is None else chosen.unionByName(best)
        if number == rounds:
            break
        picked = best.select(*key, F.col("claim_id").alias("picked_id"), "picked_tokens")
        likeness = T.jaccard(F.col("tokens"), F.col("picked_tokens"))
        state = pinned(
            state.join(picked, key)
            .where(F.col("claim_id") != F.col("picked_id"))
            .withColumn("redundancy", F.greatest("redundancy", likeness))
            .drop("picked_id", "picked_tokens")
        )
    return chosen.select("query_id", "page_id", "claim_id", "relevance", "pick")


def first_picks(
    claims: DataFrame, picks: str, lam: float = LAMBDA, group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """(query_id, page_id, claim_id, relevance, pick): the first `picks` claims of each group.

    `claims` is a pinned table (query_id, page_id, claim_id, seq, relevance, tokens, picks column).
    All claims of a page compete. Groups up to `group_limit` claims are ordered in one task each,
    larger ones in distributed rounds; both give the same order.
    """
    if not 0 <= lam <= 1:
        raise ValueError("invalid_mmr_lambda")
    key = ["query_id", "page_id"]
    sizes = claims.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > group_limit).select(*key)
    if large.isEmpty():
        return _small_groups(claims, picks, lam)
    small = _small_groups(claims.join(large, key, "left_anti"), picks, lam)
    return small.unionByName(_large_groups(claims.join(large, key, "left_semi"), picks, lam))
