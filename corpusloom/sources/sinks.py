"""Content of idempotent writes: replaced or deleted versions, only new keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def replaced(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """Table content after replacing the rows of the `changed` versions by `new` rows."""
    return old.join(changed.select("version_id").distinct(), "version_id", "left_anti").unionByName(new)


def without_versions(old: DataFrame, gone: DataFrame) -> DataFrame:
    """Table content after deleting versions; deleting an absent version changes nothing."""
    return old.join(gone.select("version_id").distinct(), "version_id", "left_anti")


def only_new(incoming: DataFrame, existing: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows to insert: one per key (the least row), none whose key exists already."""
    rest = [c for c in incoming.columns if c not in key]
    first = incoming.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row"))
    rows = first.select(*key, *(F.col("_row")[c].alias(c) for c in rest))
    return rows.join(existing.select(*key).distinct(), list(key), "left_anti").select(*incoming.columns)
