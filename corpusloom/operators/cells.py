"""Cosine search over a written table of vectors in cells; exact, with far cells left out by a bound.

| table | rows |
| --- | --- |
| `rows` | (cell, chunk_id, kb_id, vector), range-partitioned and sorted by cell |
| `cells` | (cell, centroid, radius, n): unit centroid, greatest angle of a member to it, members |

Centroids are fitted by k-means on at most `SAMPLE_PER_CELL` vectors a cell, chosen by a hash of the id; every
vector is indexed. There are at most `MAX_CELLS` cells, so what tasks hold of them is bounded. A vector of
length zero has no direction: such rows stand in cell -1, which every query reads, and score 0.

A search reads the `probes` nearest cells of each query first. The k-th best score there is a floor: a cell whose
centroid is at angle t holds nothing better than cos(t - radius), so only cells whose bound reaches the floor
are read too. Vectors that lie in groups leave most cells out; vectors that point anywhere leave out few, and the
answer is the same. Rows of a cell are dealt over parts of `PART_ROWS` and its queries over blocks of
`PART_QUERIES`, so a cell with a third of all rows is spread and a task's scores stay bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import scan
from corpusloom.operators.dense import _unit
from corpusloom.operators.ordering import top_k
from corpusloom.session import pinned

MAX_CELLS = 4096
CELL_ROWS = 1000
SAMPLE_PER_CELL = 256
PART_ROWS = 100_000
PART_QUERIES = 512
MARGIN = 1e-6
NO_DIRECTION = -1


@dataclass(frozen=True)
class CellIndex:
    """Scans of a written index."""

    spark: SparkSession
    root: str

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/rows")

    @property
    def cells(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/cells")


def _matrix(column: pd.Series) -> np.ndarray:
    return _unit(np.stack(column.to_numpy()).astype(np.float64))


def _fit(vectors: DataFrame, total: int, cells: int, seed: int) -> np.ndarray:
    """Unit centroids; the sample is a documented bound, the vectors are all indexed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    share = min(1.0, cells * SAMPLE_PER_CELL / total)
    chosen = F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    directed = F.exists("vector", lambda x: x != 0)
    raw = vectors.where(chosen & directed).select(array_to_vector(F.col("vector").cast("array<double>")).alias("raw"))
    unit = pinned(Normalizer(inputCol="raw", outputCol="features").transform(raw).select("features"))
    different = unit.select(vector_to_array("features").alias("x")).distinct().limit(cells)
    cells = different.count()
    if cells < 2:  # k-means wants two points that differ
        return np.array([row["x"] for row in different.collect()])
    model = KMeans(k=cells, seed=seed, maxIter=10, initSteps=2).fit(unit)
    return _unit(np.array(model.clusterCenters()))


def build(vectors: DataFrame, path: str, cells: int | None = None, seed: int = 7) -> CellIndex:
    """Write the index of (chunk_id, kb_id, vector); a row without a vector is left out."""
    spark = vectors.sparkSession
    given = vectors.where("vector IS NOT NULL").select("chunk_id", "kb_id", "vector")
    total = given.count()
    if cells is None:
        cells = min(MAX_CELLS, -(-total // CELL_ROWS))
    centroids = _fit(given, total, max(cells, 2), seed) if total else np.zeros((0, 0))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            unit = _matrix(batch["vector"])
            cosines = unit @ centroids.T if len(centroids) else np.zeros((len(batch), 1))
            nearest = cosines.argmax(axis=1)
            angle = np.arccos(np.clip(cosines[np.arange(len(batch)), nearest], -1, 1))
            flat = ~unit.any(axis=1)
            yield batch.assign(cell=np.where(flat, NO_DIRECTION, nearest).astype(np.int32), angle=np.where(flat, np.pi, angle))

    types = dict(given.dtypes)
    schema = ", ".join(f"{name} {types[name]}" for name in given.columns) + ", cell int, angle double"
    placed = given.mapInPandas(assign, schema).repartitionByRange("cell", "chunk_id").sortWithinPartitions("cell", "chunk_id")
    placed.write.mode("overwrite").parquet(f"{path}/rows")
    written = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    sizes = written.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n"))
    known = [(n, [float(x) for x in c]) for n, c in enumerate(centroids)]
    named = spark.createDataFrame(known, "cell int, centroid array<double>")  # at most MAX_CELLS rows
    sizes.join(named, "cell", "left").write.mode("overwrite").parquet(f"{path}/cells")
    return CellIndex(spark, path)


def _scored(index: CellIndex, probes: DataFrame, k: int) -> DataFrame:
    """The k best rows of each (query, cell part) of `probes` (query_id, vector, scope, cell)."""
    parts = index.cells.select("cell", F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts"))
    asked = probes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART_QUERIES).cast("int").alias("blocks"))
    sizes = F.broadcast(parts.join(asked, "cell"))  # at most MAX_CELLS rows
    part = F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int")
    block = F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    rows = index.rows.join(sizes, "cell").withColumn("part", part).withColumn("block", every("blocks"))
    told = probes.join(sizes, "cell").withColumn("block", block).withColumn("part", every("parts"))
    types = dict(index.rows.dtypes), dict(probes.dtypes)
    schema = f"query_id {types[1]['query_id']}, chunk_id {types[0]['chunk_id']}, score double"

    def score(queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        best = pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})
        if not len(queries) or not len(found):
            return best
        asked, ids = _matrix(queries["vector"]).T, queries["query_id"].to_numpy()
        scopes = [None if scope is None else list(scope) for scope in queries["scope"]]
        for batch in scan.slices(iter([found]), len(ids)):
            scores = scan.rounded(_matrix(batch["vector"]) @ asked)
            at, column = scan.best_rows(scores, scan.allowed_matrix(scopes, batch["kb_id"].to_numpy()), k)
            hits = pd.DataFrame(
                {"query_id": ids[column], "chunk_id": batch["chunk_id"].to_numpy()[at], "score": scores[at, column]}
            )
            best = scan.keep_best(pd.concat([best, hits]) if len(best) else hits, k)
        return best

    key = ["cell", "part", "block"]
    left = told.select(*key, "query_id", "vector", "scope").groupBy(*key)
    right = rows.select(*key, "chunk_id", "kb_id", "vector").groupBy(*key)
    return left.cogroup(right).applyInPandas(score, schema)


def search(index: CellIndex, queries: DataFrame, k: int, probes: int = 8, exact: bool = True) -> DataFrame:
    """(query_id, chunk_id, score, position): cosine top-k of (query_id, vector[, scope]).

    With `exact` false only the `probes` nearest cells are read. A query without a vector has no hits; ids of
    queries are distinct.
    """
    cells = index.cells.orderBy("cell").collect()  # at most MAX_CELLS rows and one
    numbers = np.array([row["cell"] for row in cells], dtype=np.int32)
    real = numbers >= 0
    centroids = np.array([row["centroid"] for row in cells if row["cell"] >= 0], dtype=np.float64)
    radii = np.array([row["radius"] for row in cells], dtype=np.float64)
    scope = F.col("scope") if "scope" in queries.columns else F.lit(None).cast("array<string>")
    asked = pinned(queries.where("vector IS NOT NULL").select("query_id", "vector", scope.alias("scope")))

    def choose(floors: bool):
        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch) or not len(numbers):
                    continue
                cosines = np.ones((len(batch), len(numbers)))
                if len(centroids):
                    cosines[:, real] = _matrix(batch["vector"]) @ centroids.T
                place = np.argsort(np.argsort(-cosines, axis=1, kind="stable"), axis=1)
                first = (place < probes + int((~real).sum())) | ~real
                wanted = first
                if floors:
                    angle = np.arccos(np.clip(cosines, -1, 1)) - radii - MARGIN
                    bound = np.cos(np.clip(angle, 0, np.pi)) + MARGIN
                    wanted = ~first & (bound >= batch["floor"].fillna(-2.0).to_numpy()[:, None])
                at, cell = np.nonzero(wanted)
                yield batch[["query_id", "vector", "scope"]].iloc[at].assign(cell=numbers[cell])

        return step

    types = dict(asked.dtypes)
    schema = f"query_id {types['query_id']}, vector {types['vector']}, scope {types['scope']}, cell int"
    hits = _scored(index, asked.mapInPandas(choose(False), schema), k)
    if exact:
        hits = pinned(hits)
        order = [F.desc("score"), "chunk_id"]
        floors = top_k(hits, ["query_id"], order, k, into="position").where(F.col("position") == k)
        rest = asked.join(floors.select("query_id", F.col("score").alias("floor")), "query_id", "left")
        hits = hits.unionByName(_scored(index, rest.mapInPandas(choose(True), schema), k))
    return top_k(hits, ["query_id"], [F.desc("score"), "chunk_id"], k, into="position")
