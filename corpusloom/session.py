"""Session helpers shared by tests, the benchmark and the jobs."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the jobs are written for."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("corpusloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CORPUSLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints: what the cluster names, a temporary one only locally."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is not None:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="corpusloom-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it ends; else they stay until the driver happens to collect its garbage.

    Only for results that are written: a frame executed inside must not be executed again itself.
    """
    before = spark.conf.get(FILE_CLEANUP, "false")
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(FILE_CLEANUP, before)


def pinned(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared checkpoint folder and read it from there afterwards."""
    checkpoint_root(df.sparkSession)
    with shuffles_released(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """`pinned` for tables that carry texts: compressed Parquet, so only the columns in question are read again."""
    path = f"{checkpoint_root(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with shuffles_released(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A counted side of a join: hinted for broadcast up to `max_rows`, left to the planner beyond.

    The hint keeps the other, text-carrying side from being shuffled; rows must be narrow (ids).
    """
    rows = pinned(df)
    return F.broadcast(rows) if rows.limit(max_rows + 1).count() <= max_rows else rows
