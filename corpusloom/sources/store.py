"""The fifteen model tables and the vector table as Parquet under one root."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.schemas import MODEL

# Tables whose scans are usually limited to some bases are laid out by base.
PARTITIONED = {"wiki_pages": "kb_id", "documents_dim": "kb_id"}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan a model table with its declared schema."""
    columns = spark.createDataFrame([], MODEL[name]).columns
    return spark.read.schema(MODEL[name]).parquet(f"{root}/{name}").select(*columns)


def write_table(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> None:
    """Write a model table in its declared column order and types."""
    empty = df.sparkSession.createDataFrame([], MODEL[name])
    columns = [F.col(field.name).cast(field.dataType).alias(field.name) for field in empty.schema]
    writer = df.select(*columns).write.mode(mode)
    if name in PARTITIONED:
        writer = writer.partitionBy(PARTITIONED[name])
    writer.parquet(f"{root}/{name}")
