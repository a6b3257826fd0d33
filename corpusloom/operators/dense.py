"""Cosine search over vectors: exact scan and an approximate LSH form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from corpusloom.operators import scan
from corpusloom.operators.ordering import top_k
from corpusloom.session import broadcast_if_small


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def cosine_kernel(block: list[Row]) -> scan.Kernel:
    queries = _unit(np.array([row["vector"] for row in block], dtype=np.float64)).T
    scopes = [row["scope"] if "scope" in row else None for row in block]

    def kernel(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        rows = _unit(np.stack(batch["vector"].to_numpy()).astype(np.float64))
        return rows @ queries, scan.allowed_matrix(scopes, batch["kb_id"].to_numpy())

    return kernel


def semantic_search(
    vectors: DataFrame, queries: DataFrame, k: int, bases: DataFrame | None = None
) -> DataFrame:
    """Exact cosine top-k of (query_id, vector[, scope]) over (chunk_id, kb_id, vector)."""
    corpus = vectors.select("chunk_id", "kb_id", "vector")
    if bases is not None:
        corpus = corpus.join(broadcast_if_small(bases), "kb_id", "left_semi")
    return scan.scan_top_k(corpus, queries, cosine_kernel, k)


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two array columns in double precision."""

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(
            F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
            F.lit(0.0),
            lambda total, part: total + part,
        )

    return dot(left, right) / F.sqrt(dot(left, left) * dot(right, right))


def semantic_search_lsh(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    bucket_length: float = 1.0,
    tables: int = 6,
    radius: float = 1.2,
    seed: int = 7,
) -> DataFrame:
    """Approximate top-k: random-projection LSH join on unit vectors, exact cosine on the matches.

    Rows further than `radius` (Euclidean distance of unit vectors) may be missed.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector

    def unit(df: DataFrame) -> DataFrame:
        as_vector = df.withColumn("raw", array_to_vector(F.col("vector").cast("array<double>")))
        return Normalizer(inputCol="raw", outputCol="features").transform(as_vector)

    corpus, asked = unit(vectors.select("chunk_id", "vector")), unit(queries.select("query_id", "vector"))
    hashing = BucketedRandomProjectionLSH(
        inputCol="features", outputCol="hashes", bucketLength=bucket_length, numHashTables=tables, seed=seed
    )
    model = hashing.fit(corpus)
    near = model.approxSimilarityJoin(corpus, asked, radius, distCol="distance").select(
        F.col("datasetB.query_id").alias("query_id"),
        F.col("datasetA.chunk_id").alias("chunk_id"),
        F.round(1 - F.col("distance") ** 2 / 2, scan.SCORE_DIGITS).alias("score"),
    )
    return top_k(near, ["query_id"], [F.desc("score"), "chunk_id"], k, into="position")
