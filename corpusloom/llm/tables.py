"""Intermediate tables in the shared checkpoint folder, and numbers for documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ordering import number_rows
from corpusloom.session import written


def stored(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet to the shared checkpoint folder and read it from there: lineage ends here."""
    return written(df)


def numbered_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """`docs` with a number `__did` for each document, and (did, doc_id) of the numbers.

    A document is a doc_id with a text: rows that repeat both are one document, one doc_id on different texts makes
    different ones. Numbers ascend by doc_id, null ids last, then by a hash of the text. Where every document has an
    id of its own, which a narrow aggregate tells, the id is the number and the second table is None. Otherwise the
    distinct pairs are numbered in range blocks and the texts meet their number in one join.
    """
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    pairs = docs.select("doc_id", text.alias("tid"))
    ids = pairs.groupBy("doc_id").agg(F.min("tid").alias("low"), F.max("tid").alias("high"))
    if ids.where("doc_id is null or low <> high").isEmpty():
        return docs.withColumn("__did", F.col("doc_id")), None
    ordered = pairs.distinct().withColumns({"all": F.lit(""), "unnamed": F.col("doc_id").isNull()})
    numbers = stored(number_rows(ordered, ["all"], ["unnamed", "doc_id", "tid"], into="did").select("did", "doc_id", "tid"))
    known = numbers.select(F.col("did").alias("__did"), F.col("doc_id").alias("__id"), F.col("tid").alias("__tid"))
    same = docs["doc_id"].eqNullSafe(known["__id"]) & (text == known["__tid"])
    return docs.join(known, same).drop("__id", "__tid"), numbers.select("did", "doc_id")
