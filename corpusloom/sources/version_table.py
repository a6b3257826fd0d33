"""A version-keyed table whose replaced or deleted versions appear or vanish at once.

Layout under the table's folder:

| path | holds |
| --- | --- |
| `data/generation=<id>/version_bucket=<n>` | rows of one bucket as one write left them, in files of bounded rows |
| `commits/<no>` | one JSON line: schema, number of buckets, and the generation that each filled bucket is read from |

A write adds a generation with the buckets it touches and then a commit; readers take the highest commit, so
until it is there they see the old state, and what a broken run left behind is never read. Files of a commit
are renamed into place, which must be atomic as on HDFS; a commit number that is taken already means that
another writer was first, and the run fails without effect. `vacuum` removes what no commit names any more.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corpusloom.sources.sinks import replaced

BUCKET_ROWS = 4_000_000
FILE_ROWS = 1_000_000


@dataclass(frozen=True)
class Commit:
    """One state of the table; `live` has one entry per filled bucket."""

    number: int
    schema: StructType
    buckets: int
    live: dict[int, str]


def _place(spark: SparkSession, folder: str) -> tuple[Any, Any]:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, folder: str) -> list[str]:
    files, place = _place(spark, folder)
    return [entry.getPath().getName() for entry in files.listStatus(place)] if files.exists(place) else []


def _delete(spark: SparkSession, folder: str) -> None:
    files, place = _place(spark, folder)
    files.delete(place, True)


def commits(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the commits of a table, ascending."""
    return sorted(int(name) for name in _names(spark, f"{path}/commits") if name.isdigit())


def commit_at(spark: SparkSession, path: str, number: int | None = None) -> Commit:
    """A commit by number, the newest one by default."""
    known = commits(spark, path)
    if not known or (number is not None and number not in known):
        raise ValueError("version_table_not_found")
    number = known[-1] if number is None else number
    told = json.loads(spark.read.text(f"{path}/commits/{number}").first()["value"])
    live = {int(bucket): generation for bucket, generation in told["live"].items()}
    return Commit(number, StructType.fromJson(told["schema"]), told["buckets"], live)


def _publish(spark: SparkSession, path: str, commit: Commit) -> None:
    told = {"schema": commit.schema.jsonValue(), "buckets": commit.buckets, "live": commit.live}
    staged = f"{path}/staged/{uuid.uuid4().hex}"
    files, source = _place(spark, staged)
    out = files.create(source, False)
    out.write(bytearray(json.dumps(told).encode()))
    out.close()
    _, target = _place(spark, f"{path}/commits/{commit.number}")
    files.mkdirs(target.getParent())
    if files.exists(target) or not files.rename(source, target):
        files.delete(source, False)
        raise RuntimeError("version_table_changed")


def _with_bucket(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("version_bucket", F.pmod(F.xxhash64("version_id"), F.lit(buckets)).cast("int"))


def _write_generation(rows: DataFrame, path: str, columns: list[str]) -> dict[int, str]:
    """Write bucketed rows; returns the buckets that got rows.

    Ranges over bucket and row split a hot version over tasks; a task with many rows writes several files.
    """
    generation = uuid.uuid4().hex
    folder = f"{path}/data/generation={generation}"
    (
        rows.repartitionByRange("version_bucket", "version_id", F.xxhash64(*columns))
        .sortWithinPartitions("version_bucket", "version_id")
        .write.option("maxRecordsPerFile", FILE_ROWS)
        .partitionBy("version_bucket")
        .parquet(folder)
    )
    names = _names(rows.sparkSession, folder)
    return {int(n.split("=")[1]): generation for n in names if n.startswith("version_bucket=")}


def _scan(spark: SparkSession, path: str, commit: Commit, buckets: list[int] | None = None) -> DataFrame:
    """Rows of all or some buckets, with `version_bucket`; only live folders are listed."""
    wanted = commit.live if buckets is None else {b: commit.live[b] for b in buckets if b in commit.live}
    schema = StructType([*commit.schema.fields, StructField("version_bucket", IntegerType())])
    if not wanted:
        return spark.createDataFrame([], schema)
    folders = [f"{path}/data/generation={generation}/version_bucket={b}" for b, generation in sorted(wanted.items())]
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*folders).select(*schema.names)


def create(df: DataFrame, path: str, buckets: int | None = None) -> None:
    """Write a table with a column `version_id`; the number of buckets follows from the counted rows.

    Called on a table that is there already it replaces the whole content by a new commit, with buckets for
    its new size.
    """
    spark = df.sparkSession
    if buckets is None:
        buckets = max(1, -(-df.count() // BUCKET_ROWS))
    live = _write_generation(_with_bucket(df, buckets), path, df.columns)
    known = commits(spark, path)
    _publish(spark, path, Commit(known[-1] + 1 if known else 0, df.schema, buckets, live))


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The rows of the newest commit, or of an earlier one that was not vacuumed."""
    return _scan(spark, path, commit_at(spark, path, number)).drop("version_bucket")


def replace(new: DataFrame, changed: DataFrame, path: str) -> None:
    """Replace the rows of the `changed` versions by `new` rows; only buckets that hold one are rewritten.

    A repeated run gives the same rows. Versions of `new` that are not in `changed` are added to what is there.
    """
    spark = new.sparkSession
    commit = commit_at(spark, path)
    columns = commit.schema.names
    fresh = _with_bucket(new.select(*columns), commit.buckets)
    gone = _with_bucket(changed.select("version_id"), commit.buckets)
    touched = gone.select("version_bucket").union(fresh.select("version_bucket")).distinct()
    numbers = [row["version_bucket"] for row in touched.collect()]  # at most the number of buckets
    if not numbers:
        return
    content = replaced(_scan(spark, path, commit, numbers), fresh, changed)
    live = {b: g for b, g in commit.live.items() if b not in set(numbers)}
    live |= _write_generation(content, path, columns)
    _publish(spark, path, Commit(commit.number + 1, commit.schema, commit.buckets, live))


def delete(gone: DataFrame, path: str) -> None:
    """Delete versions; an absent one changes no row."""
    spark = gone.sparkSession
    replace(spark.createDataFrame([], commit_at(spark, path).schema), gone, path)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete commits before the newest `keep`, and folders that no kept commit names.

    Not to be run beside a writer, whose generation no commit names yet.
    """
    if keep < 1:
        raise ValueError("invalid_keep")
    known = commits(spark, path)
    named = {(g, b) for number in known[-keep:] for b, g in commit_at(spark, path, number).live.items()}
    for number in known[:-keep]:
        _delete(spark, f"{path}/commits/{number}")
    generations = {generation for generation, _ in named}
    for entry in _names(spark, f"{path}/data"):
        generation = entry.removeprefix("generation=")
        if generation not in generations:
            _delete(spark, f"{path}/data/{entry}")
            continue
        for part in _names(spark, f"{path}/data/{entry}"):
            if part.startswith("version_bucket=") and (generation, int(part.split("=")[1])) not in named:
                _delete(spark, f"{path}/data/{entry}/{part}")
