"""Extension points: sectioners, embedders, rerankers, generators, and the five read-only tools.

A plug-in is a function on columns or DataFrames, so what it does stays inside the Spark plan; a
model is wrapped in an iterator pandas UDF that loads it once per task.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from corpusloom.functions import text as T
from corpusloom.operators import chunking
from corpusloom.sources import uploads

Sectioner = Callable[[Column], Column]
_SECTIONERS: dict[str, Sectioner] = {}


def register_sectioner(suffix: str, sectioner: Sectioner) -> None:
    """Use `sectioner(text)` for files with this suffix; it returns an array of sections."""
    _SECTIONERS[suffix.lower()] = sectioner


def sections_by_suffix(suffix: Column, text: Column) -> Column:
    """Sections by the registered sectioner of the file's suffix, null where there is none."""
    chosen = F.lit(None)
    for name, sectioner in _SECTIONERS.items():
        chosen = F.when(suffix == name, sectioner(text)).otherwise(chosen)
    return chosen


register_sectioner(".txt", chunking.whole_text_section)
register_sectioner(".md", uploads.markdown_sections)
register_sectioner(".html", uploads.html_sections)


def hash_embedder(dimension: int = 64) -> Callable[[Column], Column]:
    """The default embedder: signed feature hashing of the tokens, unit length."""

    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codes: dict[str, int] = {}

        def code_of(word: str) -> int:
            if len(codes) > 1_000_000:
                codes.clear()
            code = codes[word] = zlib.crc32(word.encode())
            return code

        for tokens in batches:
            lists = tokens.to_numpy()
            sizes = np.fromiter((0 if words is None else len(words) for words in lists), np.int64, len(lists))
            flat = np.fromiter(
                (codes[w] if w in codes else code_of(w) for words in lists if words is not None for w in words),
                np.int64,
                int(sizes.sum()),
            )
            cells = np.repeat(np.arange(len(lists)), sizes) * dimension + flat % dimension
            signs = np.where(flat & 0x80000000, 1.0, -1.0)
            sums = np.bincount(cells, signs, len(lists) * dimension).astype(np.float64).reshape(-1, dimension)
            norms = np.linalg.norm(sums, axis=1, keepdims=True)
            vectors = (sums / np.where(norms == 0, 1.0, norms)).astype(np.float32)
            yield pd.Series(list(vectors), index=tokens.index)

    udf = F.pandas_udf(embed, ArrayType(FloatType()))
    return lambda text: udf(T.terms(T.fold(text)))


def embed_children(
    children: DataFrame, embedder: Callable[[Column], Column], dimension: int
) -> DataFrame:
    """Add `vector` and `vector_ok`; a missing or wrongly sized vector is not ok."""
    text = F.coalesce("embedding_text", "content")
    embedded = children.withColumn("vector", embedder(text))
    ok = F.coalesce(F.size("vector") == dimension, F.lit(False))
    return embedded.withColumn("vector_ok", ok)


def token_overlap_score(query: Column, passage: Column) -> Column:
    """The default reranker's score: share of the query's tokens in the passage."""
    return F.round(T.overlap_share(T.token_set(query), T.token_set(passage)), 6)


def pair_scorer(score: Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    """Wrap a (query, passage) scorer; a pair whose scoring fails yields null, not an error."""

    def safe(query: str, passage: str) -> float | None:
        try:
            return float(score(query, passage))
        except Exception:
            return None

    @F.pandas_udf(DoubleType())
    def scored(queries: pd.Series, passages: pd.Series) -> pd.Series:
        pairs = zip(queries, passages, strict=True)
        return pd.Series([safe(q, p) for q, p in pairs], dtype="float64")

    return scored


GENERATION_SCHEMA = "doc_id long, version_id string, batch long, reply string, measured_tokens long"


def generate_replies(
    children: DataFrame, generate: Callable[[str, list[tuple[int, str]]], tuple[str, int | None]]
) -> DataFrame:
    """Call a generator once per batch of twelve children; its JSON replies are checked afterwards.

    `children` is (doc_id, version_id, title, child_index, content). A batch is one bounded row, so
    batches of all documents are spread over the cluster and handed to Python in Arrow blocks.
    `generate(title, [(index, excerpt), ...])` returns the reply and its token count or None.
    """
    batch = F.floor((F.col("child_index") - 1) / 12)
    excerpts = F.array_sort(F.collect_list(F.struct("child_index", F.substring("content", 1, 1600).alias("text"))))
    batches = children.groupBy("doc_id", "version_id", batch.alias("batch")).agg(
        F.max("title").alias("title"), excerpts.alias("excerpts")
    )

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            told = [
                generate(title, [(row["child_index"], row["text"]) for row in rows])
                for title, rows in zip(frame["title"], frame["excerpts"], strict=True)
            ]
            out = frame[["doc_id", "version_id", "batch"]].copy()
            out["reply"] = [reply for reply, _ in told]
            out["measured_tokens"] = pd.array([tokens for _, tokens in told], dtype="Int64")
            yield out

    return batches.mapInPandas(call, GENERATION_SCHEMA)
