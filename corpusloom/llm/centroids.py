"""Centroid clustering whose assignments skip centroids by Ptolemaic lower bounds.

For a vector x, a centroid c and pivots p and q Ptolemy's inequality gives
d(x, c) >= |d(x, p) d(c, q) - d(x, q) d(c, p)| / d(p, q). The pivots are fixed for all rounds, so the distances of a
vector to them are computed once and written beside it; a round computes those of the centroids, bounds all
centroids of a batch of vectors over all pivot pairs, and checks centroids exactly in the order of their bounds
until the next bound exceeds the least distance met. Bounds are made smaller by more than the rounding of their
terms, and a centroid whose bound equals that distance is still checked, so ties go to the smaller number.

A component x becomes the integer floor(256 x), kept within +-2^27 so that squared distances fit 64 bits; all
distances and sums are exact integers. Centroids start as the vectors least by the hex SHA-256 of `2:` and the
vec_id (ties by the components, null ids last). What the driver holds and ships is k centroids, k sums and the
pivots, whatever the number of vectors: each task adds up its vectors by cluster before anything is shuffled.

Vectors with another number of components, or with a null or non-finite one, are left out. Repeated rows are
clustered alike and each counts. Fewer vectors than k make fewer centroids, none make no rows. Columns other than
vec_id and embedding are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tables import stored

WIDTH, SCALE, LIMIT = 64, 256, 1 << 27
K, ROUNDS, PIVOTS = 40, 5, 6
SLACK = 1e-9  # far above the rounding of a bound (a few 2^-52 of its terms), far below what a bound decides
ROWS = 4096


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that count, as integers."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform(
        "embedding",
        lambda x: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), x.cast("double") * SCALE))).cast("int"),
    )
    return embeddings.where((F.size("embedding") == WIDTH) & whole).select("vec_id", scaled.alias("v"))


def first_centroids(vectors: DataFrame, k: int = K) -> np.ndarray:
    """The k vectors least by the hash of their id."""
    order = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(order.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64).reshape(-1, WIDTH)


def square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of `a` to all rows of `b`, both short tables or one of them."""
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1) if len(b) else np.zeros((len(a), 0), np.int64)


def pivots_of(centroids: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Up to n different rows, each the farthest from those before it."""
    chosen = [0] if len(centroids) else []
    while chosen and len(chosen) < n:
        far = square_distances(centroids, centroids[chosen]).min(axis=1)
        if far.max() == 0:
            break
        chosen.append(int(far.argmax()))
    return centroids[chosen]


def lower_bounds(to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Bounds of the distances of vectors, known by their squared pivot distances, to all centroids."""
    bounds = np.zeros((len(to_pivots), len(centroids)))
    x, c = np.sqrt(to_pivots.astype(np.float64)), np.sqrt(square_distances(centroids, pivots).astype(np.float64))
    between = np.sqrt(square_distances(pivots, pivots).astype(np.float64))
    for p in range(len(pivots)):
        for q in range(p):
            one, other = np.outer(x[:, p], c[:, q]), np.outer(x[:, q], c[:, p])
            gap = np.abs(one - other) - SLACK * (one + other)
            np.maximum(bounds, gap / between[p, q], out=bounds)
    return bounds * (1 - SLACK)


def nearest(v: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, squared distance and number of centroids checked exactly, of each vector."""
    bounds = lower_bounds(to_pivots, centroids, pivots)
    order = np.argsort(bounds, axis=1, kind="stable")
    squared = np.take_along_axis(bounds, order, axis=1) ** 2
    best = np.full(len(v), np.iinfo(np.int64).max)
    cluster, checked = np.zeros(len(v), dtype=np.int64), np.zeros(len(v), dtype=np.int64)
    left = np.arange(len(v))
    for j in range(len(centroids)):
        left = left[squared[left, j] <= best[left].astype(np.float64) * (1 + SLACK)]
        if not len(left):
            break
        number = order[left, j]
        found = ((v[left] - centroids[number]) ** 2).sum(axis=1)
        better = (found < best[left]) | ((found == best[left]) & (number < cluster[left]))
        best[left[better]], cluster[left[better]] = found[better], number[better]
        checked[left] += 1
    return cluster, best, checked


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, pivots: np.ndarray) -> Iterator[tuple]:
    """Parts of batches with their vectors and what `nearest` says of them."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            v = matrix(part.column("v"), WIDTH)
            yield part, v, nearest(v, matrix(part.column("far"), len(pivots)), centroids, pivots)


def with_pivot_distances(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = square_distances(matrix(batch.column("v"), WIDTH), pivots)
            offsets = np.arange(len(far) + 1, dtype=np.int32) * len(pivots)
            yield batch.append_column("far", pa.ListArray.from_arrays(pa.array(offsets), pa.array(far.ravel())))

    return vectors.mapInArrow(run, "vec_id long, v array<int>, far array<long>")


def moved(vectors: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after one round: floored means, and the old ones of empty clusters."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((len(centroids), WIDTH), dtype=np.int64), np.zeros(len(centroids), dtype=np.int64)
        for _, v, (cluster, _, _) in assigned(batches, centroids, pivots):
            order = np.argsort(cluster, kind="stable")
            there, first = np.unique(cluster[order], return_index=True)
            total[there] += np.add.reduceat(v[order], first, axis=0)
            count += np.bincount(cluster, minlength=len(count))
        met = np.flatnonzero(count)
        place = np.tile(np.arange(WIDTH), len(met))
        columns = [pa.array(x) for x in (np.repeat(met, WIDTH), place, np.repeat(count[met], WIDTH), total[met].ravel())]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "place", "n", "total"])

    parts = vectors.mapInArrow(sums, "cluster long, place long, n long, total long").groupBy("cluster", "place")
    new = centroids.copy()
    for r in parts.agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect():
        new[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
    return new


def cluster_vectors(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and n_checked of every vector that counts.

    distance is squared, to the vector's final centroid; n_checked counts the centroids that the bounds did not
    exclude in the last assignment.
    """
    plain = integer_vectors(embeddings)
    centroids = first_centroids(plain, k)
    pivots = pivots_of(centroids)
    vectors = stored(with_pivot_distances(plain, pivots))
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(vectors, centroids, pivots)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, (cluster, distance, checked) in assigned(batches, centroids, pivots):
            columns = [part.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(checked.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "n_checked"])

    rows = stored(vectors.mapInArrow(final, "vec_id long, cluster int, distance long, n_checked int"))
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("sum")).collect()
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    totals = [(r["cluster"], int(r["sum"]), sum(int(x["sum"]) for x in sums), digests[r["cluster"]]) for r in sums]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    clusters = rows.sparkSession.createDataFrame(totals, schema)  # at most k rows
    return rows.join(F.broadcast(clusters), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_checked"
    )
