"""The five read-only tools as batch functions over a corpus: many calls at once, one plan each.

Every tool checks its arguments first and keeps a status row for calls without a result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import bm25, dense
from corpusloom.plans import integrity, retrieve, wiki_search
from corpusloom.session import pinned
from corpusloom.sources.search_index import SearchIndex

MODES = ("hybrid", "semantic", "keyword")


@dataclass(frozen=True)
class Corpus:
    """The tables a tool reads.

    chunks (chunk_id, version_id, kb_id, kind, ordinal, parent_chunk_id, heading_path, content),
    children (the indexed part of chunks), vectors (chunk_id, kb_id, vector), documents (doc_id,
    kb_id, title, filename, status, active_version_id, deleted), bases (kb_id, enabled), and for the
    wiki tools pages, claims and claim_sources. With a written `index` keyword searches read no text.
    """

    chunks: DataFrame
    children: DataFrame
    vectors: DataFrame
    documents: DataFrame
    bases: DataFrame
    pages: DataFrame | None = None
    claims: DataFrame | None = None
    claim_sources: DataFrame | None = None
    index: SearchIndex | None = None

    def enabled(self) -> DataFrame:
        return self.bases.where("enabled").select("kb_id")

    def evidence(self) -> DataFrame:
        if self.pages is None or self.claims is None or self.claim_sources is None:
            raise ValueError("wiki tables are not given")
        return integrity.current_evidence(
            self.pages, self.claims, self.claim_sources, self.documents, self.chunks
        )


def scoped(calls: DataFrame) -> DataFrame:
    """Calls with `in_scope` and, where they carry one, the `scope` they search.

    A call may carry `turn_scope`, the bases its turn allows, and `requested`, those it asks for: it stays inside or is
    refused as a whole, and an empty request takes the turn's scope over.
    """
    if "turn_scope" not in calls.columns:
        return calls.withColumn("in_scope", F.lit(True))
    requested = F.coalesce("requested", F.array().cast("array<string>"))
    scope = F.when(F.size(requested) > 0, requested).otherwise(F.col("turn_scope"))
    allowed = F.coalesce(retrieve.within_scope(requested, F.col("turn_scope")), F.lit(False))
    return calls.withColumns({"in_scope": allowed, "scope": scope}).drop("turn_scope", "requested")


def with_failures(calls: DataFrame, vectors: DataFrame | None, mode: str) -> DataFrame:
    """Calls with `failed`: a search by vectors whose query has none did not run, and fails alone."""
    if mode == "keyword" or vectors is None:
        return calls.withColumn("failed", F.lit(False))
    embedded = vectors.where("vector IS NOT NULL").select("query_id", F.lit(True).alias("embedded")).distinct()
    return calls.join(embedded, "query_id", "left").withColumn("failed", F.col("embedded").isNull()).drop("embedded")


def _hits(corpus: Corpus, calls: DataFrame, vectors: DataFrame | None, mode: str, pool: int) -> DataFrame:
    if mode not in MODES:
        raise ValueError("invalid_search_options")
    if mode == "keyword":
        if corpus.index is not None:
            return bm25.index_search(corpus.index, calls, pool, corpus.enabled())
        return bm25.keyword_search(corpus.children, calls, pool, corpus.enabled())
    if vectors is None:
        raise ValueError("dense_vector_required")
    if mode == "semantic":
        asked = vectors.join(calls.drop("text"), "query_id")
        return dense.semantic_search(corpus.vectors, asked, pool, corpus.enabled())
    return retrieve.hybrid_hits(corpus.children, corpus.vectors, calls, vectors, pool, corpus.enabled(), corpus.index)


def search_knowledge(
    corpus: Corpus,
    calls: DataFrame,
    query_vectors: DataFrame | None = None,
    *,
    mode: str = "hybrid",
    limit: int = retrieve.PUBLIC_LIMIT,
    scorer: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Cited sources and status rows of search calls (query_id, text[, scope] or [, turn_scope, requested]).

    Every call has a status row: outside its turn's scope, not run for want of a vector, without a result, or ok.

    `scorer` is a rerank score over the columns text and excerpt, null where scoring failed.
    """
    if not 1 <= limit <= retrieve.PUBLIC_LIMIT:
        raise ValueError("invalid_search_options")
    judged = pinned(with_failures(scoped(calls), query_vectors, mode))
    asked = judged.where("in_scope AND NOT failed").where(T.strip(F.col("text")) != "").drop("in_scope", "failed")
    hits = _hits(corpus, asked, query_vectors, mode, retrieve.PUBLIC_POOL)
    found = retrieve.sources(
        retrieve.hydrate(hits, corpus.chunks, corpus.documents, corpus.bases), deduplicate_parents=True
    )
    if scorer is not None:
        found = retrieve.rerank(found.join(asked.select("query_id", "text"), "query_id"), scorer, limit)
    cited = pinned(retrieve.cited(found, limit))
    return cited, retrieve.tool_status(judged.select("query_id", "in_scope", "failed"), cited)


def search_candidates(
    corpus: Corpus, calls: DataFrame, query_vectors: DataFrame | None = None, *, mode: str = "hybrid", limit: int = 40
) -> DataFrame:
    """The wider candidate pool without parent de-duplication."""
    hits = _hits(corpus, calls, query_vectors, mode, retrieve.candidate_pool(limit))
    hydrated = retrieve.hydrate(hits, corpus.chunks, corpus.documents, corpus.bases)
    return retrieve.cited(retrieve.sources(hydrated, deduplicate_parents=False), limit)


def read_document(
    corpus: Corpus, *, documents: DataFrame | None = None, hits: DataFrame | None = None
) -> DataFrame:
    """Heads of the given documents (doc_id), or the context of given chunks (request_id, chunk_id)."""
    if (documents is None) == (hits is None):
        raise ValueError("document_or_chunk_required")
    if hits is not None:
        return retrieve.read_neighbours(hits, corpus.chunks, corpus.documents, corpus.bases)
    wanted = corpus.documents.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    return retrieve.read_document_head(corpus.chunks, wanted, corpus.bases)


def list_documents(corpus: Corpus, *, title: str = "", limit: int = 20) -> DataFrame:
    return retrieve.list_documents(corpus.documents, corpus.bases, title=title, limit=limit)


def search_wiki(
    corpus: Corpus,
    calls: DataFrame,
    query_vectors: DataFrame | None = None,
    *,
    mode: str = "hybrid",
    page_limit: int = wiki_search.PAGE_LIMIT,
    claim_limit: int = wiki_search.CLAIM_LIMIT,
    character_budget: int = wiki_search.CHARACTER_BUDGET,
) -> tuple[DataFrame, DataFrame]:
    """Matched claims and status rows of wiki calls (query_id, text); invalid queries find nothing."""
    asked = wiki_search.valid_queries(calls)
    texts = asked.select("query_id", F.col("query").alias("text"))
    sources = pinned(search_candidates(corpus, texts, query_vectors, mode=mode, limit=wiki_search.SOURCE_LIMIT))
    found = pinned(
        wiki_search.search(
            asked,
            corpus.pages,
            pinned(corpus.evidence()),
            sources,
            page_limit=page_limit,
            claim_limit=claim_limit,
            character_budget=character_budget,
        )
    )
    return found, retrieve.tool_status(calls.select("query_id", F.lit(True).alias("in_scope")), found)


def read_wiki_page(corpus: Corpus, calls: DataFrame) -> DataFrame:
    """Claims of wiki pages for calls (request_id, page_id, query, cursor, limit)."""
    return wiki_search.read_pages(calls, pinned(corpus.evidence()))
