"""Numbering and running sums over groups that may be larger than one task can hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import pinned


def _row_blocks(df: DataFrame, group: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Range-partition by group and order, then tag rows with block and place in the block.

    The order columns take part in the range key, so a hot group is spread over many blocks. The
    result is pinned: totals and rows must see the same block borders.
    """
    ordered = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    place = F.monotonically_increasing_id()
    tagged = ordered.withColumns(
        {"_block": F.shiftright(place, 33), "_place": place.bitwiseAND(F.lit((1 << 33) - 1))}
    )
    return pinned(tagged)


def number_rows(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], into: str = "row_no"
) -> DataFrame:
    """`row_number()` from 1 within each group; no task sees more than one block of a group."""
    rows = _row_blocks(df, group, order)
    blocks = rows.groupBy(*group, "_block").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first")
    )
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn(
        "_offset", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    ).drop("_rows")
    return (
        rows.join(offsets, [*group, "_block"])
        .withColumn(into, F.col("_offset") + F.col("_place") - F.col("_first") + 1)
        .drop("_block", "_place", "_first", "_offset")
    )


def running_sum(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], value: str, into: str
) -> DataFrame:
    """Sum of `value` up to and including the row, in order, within each group."""
    rows = _row_blocks(df, group, order)
    blocks = rows.groupBy(*group, "_block").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn(
        "_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))
    ).drop("_sum")
    inside = (
        Window.partitionBy(*group, "_block")
        .orderBy("_place")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.withColumn("_inside", F.sum(value).over(inside))
        .join(offsets, [*group, "_block"])
        .withColumn(into, F.col("_offset") + F.col("_inside"))
        .drop("_block", "_place", "_inside", "_offset")
    )


def top_k(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], k: int | Column, into: str = "rank"
) -> DataFrame:
    """First `k` rows per group, ranked from 1.

    With a literal `k` Spark limits every group before the shuffle, so a hot group never meets in
    one task as a whole.
    """
    ranked = df.withColumn(into, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col(into) <= k)


def with_previous(
    df: DataFrame, group: Sequence[str], order: Sequence[str], columns: Sequence[str], offset: int = 1
) -> DataFrame:
    """Add `previous_<column>` from the row `offset` places earlier (later when negative).

    Rows are numbered over blocks and matched by an equi join on the number, so a group of any size
    stays spread; the window function would put it into one task.
    """
    numbered = number_rows(df, group, order, into="_no")
    earlier = numbered.select(
        *group, (F.col("_no") + offset).alias("_no"), *(F.col(c).alias(f"previous_{c}") for c in columns)
    )
    return numbered.join(earlier, [*group, "_no"], "left").drop("_no")
