"""Registered retrieval queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import tools
from corpusloom.catalog import sql as S
from corpusloom.functions import text as T
from corpusloom.operators import bm25, cells, dense
from corpusloom.plans import retrieve
from corpusloom.plugins import token_overlap_score
from corpusloom.session import checkpoint_root
from corpusloom.sources import search_index, tables


def enabled_bases(spark: SparkSession, folder: str) -> DataFrame:
    return tables.knowledge_bases(spark, folder).where("enabled").select("kb_id")


def keyword_hits(spark: SparkSession, folder: str, k: int) -> DataFrame:
    index = search_index.of(spark, folder)
    return bm25.index_search(index, tables.queries(spark, folder), k, enabled_bases(spark, folder))


def hybrid_hits(spark: SparkSession, folder: str, k: int) -> DataFrame:
    return retrieve.hybrid_hits(
        None,
        tables.document_vectors(spark, folder),
        tables.queries(spark, folder),
        tables.query_vectors(spark, folder),
        k,
        enabled_bases(spark, folder),
        search_index.of(spark, folder),
    )


def hydrated(spark: SparkSession, folder: str, hits: DataFrame) -> DataFrame:
    return retrieve.hydrate(
        hits,
        search_index.of(spark, folder).chunks,
        tables.documents_dim(spark, folder),
        tables.knowledge_bases(spark, folder),
    )


def keyword_search_topk(spark: SparkSession, folder: str) -> DataFrame:
    hits = keyword_hits(spark, folder, retrieve.PUBLIC_POOL)
    return hits.select("query_id", "chunk_id", "score", F.col("position").cast("long").alias("position"))


def bm25_stats(spark: SparkSession, folder: str) -> DataFrame:
    index = search_index.of(spark, folder)
    average = F.round(F.col("total_length") / F.col("n_chunks"), 6)
    per_base = index.table("sizes").select("kb_id", "n_chunks", average.alias("avg_length"))
    return index.table("term_stats").drop("peak").join(per_base, "kb_id")


def index_postings(spark: SparkSession, folder: str) -> DataFrame:
    """All postings as they are written, with the frequency of their term."""
    rows = search_index.of(spark, folder).described_postings()
    return rows.select("term", "chunk_id", "kb_id", F.col("tf").cast("long").alias("tf"), F.col("length").cast("long").alias("length"), "df")


def semantic_search_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = tables.chunk_vectors(spark, folder)
    hits = dense.semantic_search(vectors, tables.query_vectors(spark, folder), retrieve.PUBLIC_POOL)
    return hits.select("query_id", "chunk_id", "score", F.col("position").cast("long").alias("position"))


def semantic_search_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The search of `semantic_search_topk` over a written table of cells."""
    index = cells.build(tables.chunk_vectors(spark, folder), f"{checkpoint_root(spark)}/cells-{uuid.uuid4().hex}")
    hits = cells.search(index, tables.query_vectors(spark, folder), retrieve.PUBLIC_POOL)
    return hits.select("query_id", "chunk_id", "score", F.col("position").cast("long").alias("position"))


def hybrid_rrf_topk(spark: SparkSession, folder: str) -> DataFrame:
    hits = hybrid_hits(spark, folder, retrieve.PUBLIC_POOL)
    return hits.select("query_id", "chunk_id", "score", F.col("position").cast("long").alias("position"))


def public_search(spark: SparkSession, folder: str) -> DataFrame:
    hits = hybrid_hits(spark, folder, retrieve.PUBLIC_POOL)
    found = retrieve.sources(hydrated(spark, folder, hits), deduplicate_parents=True)
    return retrieve.cited(found, retrieve.PUBLIC_LIMIT)


def search_sources_budgeted(spark: SparkSession, folder: str) -> DataFrame:
    return public_search(spark, folder).select(
        "query_id", "citation_id", "chunk_id", "doc_id", "version_id", "title", "filename",
        F.array_join("heading_path", " > ").alias("heading"), "excerpt", "score",
        F.col("rank").cast("long").alias("rank"),
    )


def candidate_sources(spark: SparkSession, folder: str, limit: int = 40) -> DataFrame:
    hits = hybrid_hits(spark, folder, retrieve.candidate_pool(limit))
    found = retrieve.sources(hydrated(spark, folder, hits), deduplicate_parents=False)
    return retrieve.cited(found, limit)


def search_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return candidate_sources(spark, folder).select(
        "query_id", "chunk_id", "doc_id", T.sha256_hex(F.col("excerpt")).alias("excerpt_sha256"),
        "score", F.col("rank").cast("long").alias("rank"),
    )


def search_reranked(spark: SparkSession, folder: str) -> DataFrame:
    """Keyword mode with the default reranker; it fails on passages that mention no vowel pair."""
    hits = keyword_hits(spark, folder, retrieve.PUBLIC_POOL)
    found = retrieve.sources(hydrated(spark, folder, hits), deduplicate_parents=True)
    asked = found.join(tables.queries(spark, folder), "query_id")
    broken = F.col("excerpt").contains("ouou")
    score = F.when(~broken, token_overlap_score(F.col("text"), F.col("excerpt")))
    ranked = retrieve.rerank(asked, score, retrieve.PUBLIC_LIMIT)
    return ranked.select(
        "query_id", "chunk_id", "degraded", F.col("rank").cast("long").alias("rank")
    )


def search_tool_status(spark: SparkSession, folder: str) -> DataFrame:
    """Tool envelope per query; every query asks its own base, the turn's scope is the enabled ones."""
    docs = tables.documents_dim(spark, folder).select("doc_id", "kb_id")
    turn = tables.queries(spark, folder).join(docs, F.col("query_id") == F.col("doc_id"))
    bases = tables.knowledge_bases(spark, folder).select("kb_id", "enabled")
    asked = turn.join(bases, "kb_id").select(
        "query_id", "text", F.array("kb_id").alias("scope"), F.col("enabled").alias("in_scope")
    )
    hits = bm25.index_search(search_index.of(spark, folder), asked.where("in_scope"), retrieve.PUBLIC_LIMIT)
    found = hydrated(spark, folder, hits)
    return retrieve.tool_status(asked.select("query_id", "in_scope"), found)


def tool_search_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Status rows of the search tool: turns allow two bases, calls ask for none, one or others, some lack a vector."""
    docs = tables.documents_dim(spark, folder)
    own = docs.select(F.col("doc_id").alias("query_id"), "kb_id")
    number = F.col("query_id") % 4
    requested = (
        F.when(number == 0, F.array().cast("array<string>"))
        .when(number == 1, F.array(F.lit("src4")))
        .when(number == 2, F.array("kb_id"))
        .otherwise(F.array(F.col("kb_id"), F.lit("src1")))
    )
    calls = tables.queries(spark, folder).join(own, "query_id").select(
        "query_id", "text", F.array(F.col("kb_id"), F.lit("src4")).alias("turn_scope"), requested.alias("requested")
    )
    index = search_index.of(spark, folder)
    corpus = tools.Corpus(
        index.chunks, tables.children(spark, folder), tables.document_vectors(spark, folder), docs,
        tables.knowledge_bases(spark, folder), index=index,
    )
    vectors = tables.query_vectors(spark, folder).where("query_id % 5 <> 0")
    _, status = tools.search_knowledge(corpus, calls, vectors, mode="semantic")
    return status


def neighbour_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Reading requests: the last child of every version."""
    children = tables.chunks(spark, folder).where("kind = 'child'")
    last = children.groupBy("version_id").agg(F.max_by("chunk_id", "ordinal").alias("chunk_id"))
    return last.select(F.col("version_id").alias("request_id"), "chunk_id")


def read_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    rows = retrieve.read_neighbours(
        neighbour_hits(spark, folder),
        tables.chunks(spark, folder),
        tables.documents_dim(spark, folder),
        tables.knowledge_bases(spark, folder),
    )
    return rows.select(
        "request_id", "doc_id", "chunk_id", F.col("ordinal").cast("long").alias("ordinal"),
        "excerpt", F.col("rank").cast("long").alias("rank"),
    )


def read_document_head(spark: SparkSession, folder: str) -> DataFrame:
    rows = retrieve.read_document_head(
        tables.chunks(spark, folder),
        tables.documents_dim(spark, folder),
        tables.knowledge_bases(spark, folder),
    )
    return rows.select(
        "doc_id", "title", "chunk_id", "excerpt", F.col("rank").cast("long").alias("rank")
    )


def list_documents_title(spark: SparkSession, folder: str) -> DataFrame:
    return retrieve.list_documents(
        tables.documents_dim(spark, folder), tables.knowledge_bases(spark, folder), title=" OC-1 ".strip()
    )


def public_source_json(spark: SparkSession, folder: str) -> DataFrame:
    rows = retrieve.public_source(public_search(spark, folder))
    return rows.select(
        "query_id",
        F.col("rank").cast("long").alias("rank"),
        F.get_json_object("source", "$.document_id").alias("document_id"),
        F.get_json_object("source", "$.citation_id").alias("citation_id"),
        F.get_json_object("source", "$.heading_path[0]").alias("first_heading"),
        T.sha256_hex(F.get_json_object("source", "$.excerpt")).alias("excerpt_sha256"),
    )


QUERIES = {
    "keyword_search_topk": keyword_search_topk,
    "bm25_stats": bm25_stats,
    "index_postings": index_postings,
    "semantic_search_topk": semantic_search_topk,
    "semantic_search_cells": semantic_search_cells,
    "hybrid_rrf_topk": hybrid_rrf_topk,
    "search_sources_budgeted": search_sources_budgeted,
    "search_candidates": search_candidates,
    "search_reranked": search_reranked,
    "search_tool_status": search_tool_status,
    "tool_search_calls": tool_search_calls,
    "read_neighbours": read_neighbours,
    "read_document_head": read_document_head,
    "list_documents_title": list_documents_title,
    "public_source_json": public_source_json,
}

SEMANTIC = """
SELECT query_id, chunk_id, score, position FROM (
  SELECT q.vec_id AS query_id, v.vec_id AS chunk_id,
         round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(
           CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) DESC, v.vec_id) AS position
  FROM embeddings q JOIN benchmark b ON b.item_id = q.vec_id, embeddings v)
WHERE position <= 20"""

VISIBLE = """
visible AS (
  SELECT d.* FROM documents_dim d JOIN knowledge_bases b ON b.kb_id = d.kb_id AND b.enabled
  WHERE NOT d.deleted AND d.active_version_id IS NOT NULL)"""


def hydrate_sql(hits: str, name: str = "sourced", deduplicate: bool = True) -> str:
    """Hydration, parent de-duplication and excerpt budget over a hits relation."""
    first = "WHERE nth = 1" if deduplicate else ""
    return f"""
{name}_hydrated AS (
  SELECT h.query_id, h.chunk_id, h.score, h.position, v.doc_id, c.version_id, v.title, v.filename,
         v.kb_id, v.lang, p.content,
         row_number() OVER (PARTITION BY h.query_id, c.parent_chunk_id ORDER BY h.position) AS nth
  FROM {hits} h JOIN children c USING (chunk_id) JOIN visible v ON v.active_version_id = c.version_id
       JOIN chunks p ON p.chunk_id = c.parent_chunk_id),
{name}_spent AS (
  SELECT *, 24000 - coalesce(sum(least(length(content), 500)) OVER (PARTITION BY query_id
              ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over
  FROM {name}_hydrated {first}),
{name} AS (
  SELECT *, substr(content, 1, CAST(least(500, left_over) AS BIGINT)) AS excerpt,
         row_number() OVER (PARTITION BY query_id ORDER BY position) AS rank
  FROM {name}_spent WHERE left_over > 0)"""


BASE_PARTS = (S.BASES, S.DIM, S.CHUNKS, S.QUERIES)
HYBRID_PARTS = (*BASE_PARTS, S.KEYWORD, S.DENSE, S.HYBRID, VISIBLE)
PUBLIC = "public_hits AS (SELECT query_id, chunk_id, score, rank AS position FROM fused WHERE rank <= 20)"

SQL = {
    "keyword_search_topk": S.sql(
        *BASE_PARTS, S.KEYWORD,
        select="SELECT query_id, chunk_id, score, position FROM keyword_ranked WHERE position <= 20",
    ),
    "bm25_stats": S.sql(
        S.BASES, S.CHUNKS, S.QUERIES, S.KEYWORD,
        select="""
SELECT kb_id, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, n_chunks, avg_length
FROM postings JOIN (SELECT kb_id, count(*) AS n_chunks, round(avg(len(terms)), 6) AS avg_length
                    FROM index_terms GROUP BY kb_id) USING (kb_id)
GROUP BY kb_id, term, n_chunks, avg_length""",
    ),
    "index_postings": S.sql(
        S.BASES, S.CHUNKS, S.QUERIES, S.KEYWORD,
        select="SELECT term, chunk_id, kb_id, tf, length, df FROM postings JOIN term_df USING (term)",
    ),
    "semantic_search_topk": SEMANTIC,
    "semantic_search_cells": SEMANTIC,
    "hybrid_rrf_topk": S.sql(
        *BASE_PARTS, S.KEYWORD, S.DENSE, S.HYBRID,
        select="SELECT query_id, chunk_id, score, rank AS position FROM fused WHERE rank <= 20",
    ),
    "search_sources_budgeted": S.sql(
        *HYBRID_PARTS, PUBLIC, hydrate_sql("public_hits"),
        select="""
SELECT query_id, '[' || rank || ']' AS citation_id, chunk_id, doc_id, version_id, title, filename,
       kb_id || ' > ' || lang AS heading, excerpt, score, rank
FROM sourced WHERE rank <= 8""",
    ),
    "search_candidates": S.sql(
        *HYBRID_PARTS,
        "pool AS (SELECT query_id, chunk_id, score, rank AS position FROM fused WHERE rank <= 80)",
        hydrate_sql("pool", deduplicate=False),
        select="""
SELECT query_id, chunk_id, doc_id, sha256(excerpt) AS excerpt_sha256, score, rank
FROM sourced WHERE rank <= 40""",
    ),
    "search_reranked": S.sql(
        *BASE_PARTS, S.KEYWORD, VISIBLE,
        "pool AS (SELECT query_id, chunk_id, score, position FROM keyword_ranked WHERE position <= 20)",
        hydrate_sql("pool"),
        "token_sets AS (SELECT s.*, list_distinct(" + S.TERMS.format("q.text") + ") AS qt, list_distinct("
        + S.TERMS.format("s.excerpt") + """) AS tt, contains(s.excerpt, 'ouou') AS broken
         FROM sourced s JOIN queries q USING (query_id)),
marked AS (
  SELECT *, bool_or(broken) OVER (PARTITION BY query_id)
            AND count(*) OVER (PARTITION BY query_id) > 1 AS degraded,
         round(len(list_intersect(qt, tt)) / len(qt), 6) AS rerank_score FROM token_sets),
ranked AS (
  SELECT query_id, chunk_id, degraded, row_number() OVER (PARTITION BY query_id
    ORDER BY CASE WHEN NOT degraded AND NOT broken THEN rerank_score END DESC NULLS LAST, rank) AS rank FROM marked)""",
        select="SELECT query_id, chunk_id, degraded, rank FROM ranked WHERE rank <= 8",
    ),
    "search_tool_status": S.sql(
        S.BASES, S.DIM, S.CHUNKS,
        """queries AS (
  SELECT b.item_id AS query_id, b.text, d.kb_id FROM benchmark b JOIN documents_dim d ON d.doc_id = b.item_id)""",
        S.KEYWORD.replace("b.kb_id = p.kb_id AND b.enabled,", """b.kb_id = p.kb_id AND b.enabled
       JOIN queries own ON own.query_id = q.query_id AND own.kb_id = p.kb_id,"""),
        VISIBLE,
        """found AS (
  SELECT k.query_id, count(*) AS n FROM keyword_ranked k JOIN children c USING (chunk_id)
       JOIN visible v ON v.active_version_id = c.version_id
  WHERE k.position <= 8 GROUP BY k.query_id)""",
        select="""
SELECT q.query_id,
       CASE WHEN NOT b.enabled THEN 'knowledge_scope_unavailable'
            WHEN f.n IS NULL THEN 'no_relevant_knowledge' ELSE 'ok' END AS status,
       CASE WHEN b.enabled THEN coalesce(f.n, 0) ELSE 0 END AS n_sources
FROM queries q JOIN knowledge_bases b USING (kb_id) LEFT JOIN found f USING (query_id)""",
    ),
    "tool_search_calls": S.sql(
        S.BASES, S.DIM, S.CHUNKS, S.DENSE, VISIBLE,
        """calls AS (
  SELECT b.item_id AS query_id, [d.kb_id, 'src4'] AS turn_scope,
         CASE b.item_id % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['src4'] WHEN 2 THEN [d.kb_id] ELSE [d.kb_id, 'src1'] END AS requested
  FROM benchmark b JOIN documents_dim d ON d.doc_id = b.item_id),
judged AS (
  SELECT *, list_has_all(turn_scope, requested) AS in_scope, CASE WHEN len(requested) = 0 THEN turn_scope ELSE requested END AS scope,
         query_id NOT IN (SELECT query_id FROM query_vectors WHERE query_id % 5 <> 0) AS failed
  FROM calls),
wanted AS (SELECT DISTINCT query_id, unnest(scope) AS kb_id FROM judged WHERE in_scope AND NOT failed),
tool_scores AS (
  SELECT w.query_id, v.chunk_id, round(list_cosine_similarity(q.vector, v.vector), 6) AS score
  FROM wanted w JOIN query_vectors q ON q.query_id = w.query_id JOIN document_vectors v ON v.kb_id = w.kb_id
       JOIN knowledge_bases b ON b.kb_id = v.kb_id AND b.enabled),
pool AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS position FROM tool_scores)
  WHERE position <= 20)""",
        hydrate_sql("pool"),
        "found AS (SELECT query_id, count(*) AS n FROM sourced WHERE rank <= 8 GROUP BY 1)",
        select="""
SELECT query_id, CASE WHEN NOT in_scope THEN 'knowledge_scope_unavailable' WHEN failed THEN 'retrieval_unavailable'
                      WHEN n IS NULL THEN 'no_relevant_knowledge' ELSE 'ok' END AS status,
       CASE WHEN in_scope AND NOT failed THEN coalesce(n, 0) ELSE 0 END AS n_sources
FROM judged LEFT JOIN found USING (query_id)""",
    ),
    "read_neighbours": S.sql(
        S.BASES, S.DIM, S.CHUNKS, VISIBLE,
        """hits AS (
  SELECT version_id AS request_id, max_by(chunk_id, ordinal) AS chunk_id FROM chunks
  WHERE kind = 'child' GROUP BY version_id),
around AS (
  SELECT h.request_id, v.doc_id, p.chunk_id, p.ordinal, substr(p.content, 1, 1500) AS excerpt,
         row_number() OVER (PARTITION BY h.request_id ORDER BY p.ordinal) AS rank
  FROM hits h JOIN chunks c USING (chunk_id) JOIN visible v ON v.active_version_id = c.version_id
       JOIN chunks p ON p.version_id = c.version_id AND p.kind = 'parent'
  WHERE p.chunk_id = c.parent_chunk_id OR p.ordinal BETWEEN c.ordinal - 2 AND c.ordinal + 2)""",
        select="SELECT * FROM around WHERE rank <= 3",
    ),
    "read_document_head": S.sql(
        S.BASES, S.DIM, S.CHUNKS, VISIBLE,
        select="""
SELECT doc_id, title, chunk_id, excerpt, rank FROM (
  SELECT v.doc_id, v.title, c.chunk_id, substr(c.content, 1, 1500) AS excerpt,
         row_number() OVER (PARTITION BY c.version_id ORDER BY c.ordinal) AS rank
  FROM chunks c JOIN visible v ON v.active_version_id = c.version_id WHERE c.kind = 'parent')
WHERE rank <= 3""",
    ),
    "list_documents_title": S.sql(
        S.BASES, S.DIM, VISIBLE,
        select="""
SELECT doc_id, title, filename FROM visible
WHERE contains(lower(title), 'oc-1') OR contains(lower(filename), 'oc-1')
ORDER BY title, doc_id LIMIT 20""",
    ),
    "public_source_json": S.sql(
        *HYBRID_PARTS, PUBLIC, hydrate_sql("public_hits"),
        select="""
SELECT query_id, rank, CAST(doc_id AS VARCHAR) AS document_id, '[' || rank || ']' AS citation_id,
       kb_id AS first_heading, sha256(excerpt) AS excerpt_sha256
FROM sourced WHERE rank <= 8""",
    ),
}
