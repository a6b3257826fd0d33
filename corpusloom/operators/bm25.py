"""BM25: corpus statistics, postings and two access paths for top-k search."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import scan
from corpusloom.operators.ordering import top_k
from corpusloom.session import broadcast_if_small, pinned

K1 = 1.2
B = 0.75
MAX_BLOCK_TERMS = 50_000


def with_terms(chunks: DataFrame) -> DataFrame:
    """(chunk_id, kb_id, terms, length): the tokens of each chunk, repeats kept."""
    return chunks.select("chunk_id", "kb_id", T.terms(T.fold(F.col("content"))).alias("terms")).withColumn(
        "length", F.size("terms")
    )


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, kb_id, tf, length): one row per term of a chunk, and one of the empty term.

    The empty term stands for the chunk itself, so chunks without tokens count in N and the average length.
    The grouping key holds the chunk id, so a frequent term is spread over all partitions.
    """
    terms = F.concat(F.array(F.lit("")), "terms")
    exploded = with_terms(chunks).select("chunk_id", "kb_id", "length", F.explode(terms).alias("term"))
    return exploded.groupBy("chunk_id", "kb_id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_statistics(chunks: DataFrame) -> DataFrame:
    """(kb_id, term, df, cf): document and collection frequency of each term in each base."""
    distinct = with_terms(chunks).select("kb_id", F.explode("terms").alias("term"), "chunk_id")
    per_chunk = distinct.groupBy("kb_id", "term", "chunk_id").agg(F.count(F.lit(1)).alias("tf"))
    return per_chunk.groupBy("kb_id", "term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")
    )


def query_statistics(chunks: DataFrame, words: list[str]) -> DataFrame:
    """(term, df, length) of the vocabulary in one pass, counted map-side.

    The vocabulary is that of one query block and is broadcast up to MAX_BLOCK_TERMS words.
    Every chunk also counts for the empty term, so that row carries the number of chunks and their
    total length.
    """
    vocabulary = chunks.sparkSession.createDataFrame([("",), *((w,) for w in words)], "term string")
    if len(words) <= MAX_BLOCK_TERMS:
        vocabulary = F.broadcast(vocabulary)
    marked = with_terms(chunks).select(
        "length",
        F.explode(F.concat(F.array(F.lit("")), F.array_distinct("terms"))).alias("term"),
    )
    return (
        marked.join(vocabulary, "term")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("length").alias("length"))
    )


def inverse_frequency(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_weight(tf: Column, length: Column, avg_length: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_length))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term): the distinct tokens of each query."""
    return queries.select("query_id", F.explode(T.token_set(F.col("text"))).alias("term"))


def keyword_kernel(n_chunks: int, avg_length: float, df: dict[str, int], block: list[Row]) -> scan.Kernel:
    """Scorer of a query block over (terms, length, kb_id) rows."""
    index = scan.OwnerIndex([row["terms"] for row in block], set(df))
    weight = np.array([math.log(1 + (n_chunks - df[t] + 0.5) / (df[t] + 0.5)) for t in index.words])
    scopes = [row["scope"] if "scope" in row else None for row in block]

    def kernel(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        lengths = batch["length"].to_numpy().astype(np.float64)
        rows, terms, tf = index.matches(batch["terms"].to_numpy())
        norm = K1 * (1 - B + B * lengths[rows] / avg_length)
        scores = index.spread(rows, terms, weight[terms] * tf * (K1 + 1) / (tf + norm), len(batch))
        return scores, (scores > 0) & scan.allowed_matrix(scopes, batch["kb_id"].to_numpy())

    return kernel


def keyword_search(
    chunks: DataFrame, queries: DataFrame, k: int, bases: DataFrame | None = None
) -> DataFrame:
    """BM25 top-k by one pass over the chunks per query block.

    Statistics cover the whole index, as the index keeps them; `bases` (kb_id) and a query's
    optional `scope` (list of base ids) limit the candidates only.
    """
    asked = queries.withColumn("terms", T.token_set(F.col("text"))).drop("text")

    def kernel_of(block: list[Row]) -> scan.Kernel:
        words = sorted({term for row in block for term in row["terms"]})
        counted = {row["term"]: row for row in query_statistics(chunks, words).collect()}
        total = counted.pop("", None)
        n, length = (total["df"], total["length"]) if total else (0, 0)
        df = {term: row["df"] for term, row in counted.items()}
        return keyword_kernel(n, length / n if length else 1.0, df, block)

    admitted = chunks
    if bases is not None:
        admitted = chunks.join(broadcast_if_small(bases), "kb_id", "left_semi")
    return scan.scan_top_k(with_terms(admitted), asked, kernel_of, k)


SEED_CHUNKS = 50
LEFT_OUT = 0.6  # share of the floor that the terms left out may add up to: more would let nearly all chunks stay hopeful
MARGIN = 10.0**-scan.SCORE_DIGITS


def _matches(index, terms: DataFrame, bases: DataFrame | None, scopes: DataFrame | None, average: float) -> DataFrame:
    """(query_id, chunk_no, part): what the postings of some query terms give to the chunks they name.

    Every term meets its postings salt by salt, so a frequent term's postings are spread over the join.
    """
    asked = terms.select("query_id", "term", "idf", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    rows = index.table("postings")
    if bases is not None:
        rows = rows.join(broadcast_if_small(bases), "kb_id", "left_semi")
    met = rows.join(asked, ["term", "salt"])
    if scopes is not None:
        met = met.join(scopes, "query_id").where("scope IS NULL OR array_contains(scope, kb_id)")
    weight = term_weight(F.col("tf"), F.col("length"), F.lit(average))
    return met.groupBy("query_id", "chunk_no").agg(F.sum(F.col("idf") * weight).alias("part"))


def _whole_scores(index, candidates: DataFrame, terms: DataFrame, average: float) -> DataFrame:
    """(query_id, chunk_no, chunk_id, score) of candidate chunks, from their own term counts."""
    counted = index.counted.select("chunk_no", "chunk_id", "length", "terms")
    rows = candidates.select("query_id", "chunk_no").join(counted, "chunk_no")
    held = rows.select("query_id", "chunk_no", "chunk_id", "length", F.inline("terms"))
    met = held.join(terms.select("query_id", "term", "idf"), ["query_id", "term"])
    weight = term_weight(F.col("tf"), F.col("length"), F.lit(average))
    total = F.round(F.sum(F.col("idf") * weight), scan.SCORE_DIGITS)
    return met.groupBy("query_id", "chunk_no", "chunk_id").agg(total.alias("score"))


def counted_kernel(average: float, block: list[Row]) -> scan.Kernel:
    """Scorer of a query block over record batches of chunks with their counted terms."""
    asked = scan.OwnerIndex([[t["term"] for t in row["asked"]] for row in block])
    idf = {t["term"]: t["idf"] for row in block for t in row["asked"]}
    weight = np.array([idf[word] for word in asked.words])
    words = pa.array(asked.words, pa.string())
    scopes = [row["scope"] for row in block]

    def kernel(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        lists, height = batch.column("words"), batch.num_rows
        codes = pc.index_in(lists.flatten(), value_set=words).fill_null(-1).to_numpy(zero_copy_only=False)
        sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        met = np.flatnonzero(codes >= 0)
        rows, terms = np.repeat(np.arange(height), sizes)[met], codes[met]
        tf = batch.column("counts").flatten().to_numpy(zero_copy_only=False)[met]
        lengths = scan.column_of(batch, "length").astype(np.float64)[rows]
        values = weight[terms] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths / average)))
        scores = asked.spread(rows, terms, values, height)
        return scores, (scores > 0) & scan.allowed_matrix(scopes, scan.column_of(batch, "kb_id"))

    return kernel


def _scan_counted(index, terms: DataFrame, scopes: DataFrame | None, bases: DataFrame | None, average: float, k: int) -> DataFrame:
    """Top-k by one pass over the counted chunks per query block: only the k best rows of a partition are shuffled."""
    asked = terms.groupBy("query_id").agg(F.collect_list(F.struct("term", "idf")).alias("asked"))
    asked = asked.withColumn("scope", F.lit(None)) if scopes is None else asked.join(scopes, "query_id")
    rows = index.counted
    if bases is not None:
        rows = rows.join(broadcast_if_small(bases), "kb_id", "left_semi")
    corpus = rows.select("chunk_id", "kb_id", "length", F.col("terms.term").alias("words"), F.col("terms.tf").alias("counts"))
    return scan.scan_top_k(corpus, asked, lambda block: counted_kernel(average, block), k, arrow=True)


def index_search(
    index, queries: DataFrame, k: int, bases: DataFrame | None = None, max_pairs: int | None = None
) -> DataFrame:
    """BM25 top-k from a written index, with the answer of `keyword_search`; no text is read.

    Queries whose terms have more than `max_pairs` postings together, by default one for every chunk, are scored by a
    pass over the counted chunks: their postings would be shuffled once for each query, and nearly every chunk is named.
    Others go by the postings.

    A query's rarest terms are looked up first, until they name some `SEED_CHUNKS` x k chunks, which are scored whole.
    Their k-th best score is a floor: chunks that hold only terms whose largest weights together stay below it cannot
    be among the best, so the postings of the most frequent terms are left out unless a query has little else. Of the
    chunks that the remaining terms name, those that could still reach the floor are scored whole.

    `queries` is (query_id, text[, scope]); `bases` (kb_id) and scopes limit the chunks, statistics cover the index.
    """
    whole = index.table("sizes").agg(F.sum("n_chunks").alias("n"), F.sum("total_length").alias("length")).first()
    n = whole["n"] or 0
    average = whole["length"] / n if whole["length"] else 1.0
    scopes = pinned(queries.select("query_id", "scope")) if "scope" in queries.columns else None
    idf = inverse_frequency(F.col("df"), F.lit(n))
    earlier = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    terms = pinned(
        query_terms(queries)
        .join(index.table("terms"), "term")
        .withColumns({"idf": idf, "most": idf * F.col("peak")})
        .withColumn("seed", F.coalesce(F.sum("df").over(earlier), F.lit(0)) < SEED_CHUNKS * k)
    )
    pairs = terms.agg(F.sum("df")).first()[0] or 0
    if pairs > (n if max_pairs is None else max_pairs):
        return _scan_counted(index, terms, scopes, bases, average, k)
    seeds = _matches(index, terms.where("seed"), bases, scopes, average)
    seeded = pinned(_whole_scores(index, seeds, terms, average))
    floors = (
        top_k(seeded, ["query_id"], [F.desc("score")], k)
        .groupBy("query_id")
        .agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("floor"))
    )
    # From the most frequent term on: the largest weights of these and all more frequent ones together.
    up_to = Window.partitionBy("query_id").orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
    judged = pinned(
        terms.join(floors, "query_id", "left")
        .withColumn("floor", F.coalesce("floor", F.lit(0.0)))
        .withColumn("needed", F.col("seed") | (F.sum("most").over(up_to) + MARGIN >= LEFT_OUT * F.col("floor")))
    )
    scored = seeded
    more = judged.where("needed AND NOT seed")
    if not more.isEmpty():
        rest = judged.groupBy("query_id").agg(
            F.max("floor").alias("floor"),
            F.coalesce(F.sum(F.when(~F.col("needed"), F.col("most"))), F.lit(0.0)).alias("rest"),
        )
        named = _matches(index, more, bases, scopes, average).join(rest, "query_id")
        hopeful = named.where(F.col("part") + F.col("rest") + MARGIN >= F.col("floor"))
        fresh = hopeful.join(seeded.select("query_id", "chunk_no"), ["query_id", "chunk_no"], "left_anti")
        scored = seeded.unionByName(_whole_scores(index, fresh, terms, average))
    return top_k(scored.drop("chunk_no"), ["query_id"], [F.desc("score"), "chunk_id"], k, into="position")


def keyword_search_on_postings(
    posting_rows: DataFrame, queries: DataFrame, k: int, bases: DataFrame | None = None
) -> DataFrame:
    """BM25 top-k from a written postings table, with the answer of `keyword_search`.

    Suits a large query table: queries and postings meet in an equi join on the term, nothing is
    sent to all tasks. N and the average length come from the rows of the empty term alone.
    """
    asked = query_terms(queries)
    words = asked.select("term").distinct()
    read = posting_rows.join(words, "term", "left_semi")
    df = read.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    sizes = posting_rows.where("term = ''").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg_length"))
    row = sizes.first()
    weighted = asked.join(df, "term").select(
        "query_id", "term", inverse_frequency(F.col("df"), F.lit(row["n"])).alias("idf")
    )
    weight = term_weight(F.col("tf"), F.col("length"), F.lit(row["avg_length"] or 1.0))
    admitted = read
    if bases is not None:
        admitted = admitted.join(broadcast_if_small(bases), "kb_id", "left_semi")
    met = admitted.join(weighted, "term")
    if "scope" in queries.columns:
        scopes = queries.select("query_id", "scope")
        met = met.join(scopes, "query_id").where("scope IS NULL OR array_contains(scope, kb_id)")
    scored = met.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(F.col("idf") * weight), scan.SCORE_DIGITS).alias("score")
    )
    return top_k(scored, ["query_id"], [F.desc("score"), "chunk_id"], k, into="position")
