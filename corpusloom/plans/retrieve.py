"""Batch retrieval: scope, hybrid search, hydration, excerpts, rerank, envelopes, reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import bm25, dense, fusion
from corpusloom.operators.ordering import top_k
from corpusloom.session import broadcast_if_small, pinned

CHANNEL_K = 30
PUBLIC_POOL = 20
PUBLIC_LIMIT = 8
EXCERPT_CHARACTERS = 500
EXCERPT_BUDGET = 24_000
READ_CHARACTERS = 1500
NEIGHBOUR_SPAN = 2
READ_LIMIT = 3


def candidate_pool(limit: int) -> int:
    """How many hits are fetched for a candidate search of `limit` sources."""
    if not 1 <= limit <= 100:
        raise ValueError("invalid_candidate_limit")
    return min(200, max(limit * 2, 40))


def resolve_scopes(requests: DataFrame, bases: DataFrame) -> DataFrame:
    """Decide each request (request_id, mode, selected array): its status and usable bases.

    `all_enabled` means every enabled base and stays symbolic (`scope` null): the list of all bases
    is never put into a row. `selected` ids must all exist and be enabled.
    """
    wanted = requests.select("request_id", F.explode(F.array_distinct("selected")).alias("kb_id"))
    usable = bases.where("enabled").select("kb_id", F.lit(True).alias("usable"))
    counted = (
        wanted.join(usable, "kb_id", "left")
        .groupBy("request_id")
        .agg(F.count_if(F.col("usable").isNull()).alias("missing"))
    )
    some = F.size("selected") > 0
    status = (
        F.when(~F.col("mode").isin("all_enabled", "selected"), "invalid_knowledge_scope")
        .when((F.col("mode") == "selected") & ~some, "empty_knowledge_scope")
        .when((F.col("mode") == "all_enabled") & some, "invalid_knowledge_scope")
        .when(F.coalesce("missing", F.lit(0)) > 0, "knowledge_scope_unavailable")
        .otherwise("ok")
    )
    decided = requests.join(counted, "request_id", "left").withColumn("status", status)
    scope = F.when((F.col("status") == "ok") & some, F.array_sort(F.array_distinct("selected")))
    return decided.withColumn("scope", scope).drop("missing")


def within_scope(requested: Column, scope: Column) -> Column:
    """Whether a tool call stays inside the scope of its turn; an empty request takes it over."""
    return F.size(F.array_except(requested, scope)) == 0


def query_status(
    text: Column, limit: Column, low: int = 1, high: int = 20, longest: int = 200
) -> Column:
    """Validity of a wiki query: non-empty, short enough, with a token, limit in range."""
    normal = T.normalize_query(text)
    bad = (normal == "") | (F.length(normal) > longest) | (F.size(T.terms(normal)) == 0)
    return (
        F.when(bad, "invalid_wiki_query")
        .when(~limit.between(low, high), "invalid_search_options")
        .otherwise("ok")
    )


def hybrid_hits(
    chunks: DataFrame | None,
    vectors: DataFrame,
    queries: DataFrame,
    query_vectors: DataFrame,
    k: int,
    bases: DataFrame | None = None,
    index=None,
) -> DataFrame:
    """(query_id, chunk_id, score, position): both channels at 30, fused, cut to `k`.

    The keyword channel reads the written `index` where one is given, else it scans `chunks`.
    """
    extra = [c for c in ("scope",) if c in queries.columns]
    asked = query_vectors.join(queries.select("query_id", *extra), "query_id")
    channels = fusion.tagged_union(
        [
            dense.semantic_search(vectors, asked, CHANNEL_K, bases),
            bm25.keyword_search(chunks, queries, CHANNEL_K, bases)
            if index is None
            else bm25.index_search(index, queries, CHANNEL_K, bases),
        ]
    )
    fused = fusion.reciprocal_rank_fusion(channels.withColumnRenamed("chunk_id", "item_id"))
    return fused.where(F.col("rank") <= k).select(
        "query_id", F.col("item_id").alias("chunk_id"), "score", F.col("rank").alias("position")
    )


def hydrate(hits: DataFrame, chunks: DataFrame, documents: DataFrame, bases: DataFrame) -> DataFrame:
    """Join hits to their chunk, its document and parent; hits that are not visible vanish.

    Hits are few (queries x k): their ids and then their parents' ids are broadcast to the chunk
    table after a count, so its text is read where it lies and only matching rows move.
    """
    visible = documents.where(~F.col("deleted")).join(bases.where("enabled").select("kb_id"), "kb_id")
    active = visible.select(
        "doc_id", "kb_id", "title", "filename", F.col("active_version_id").alias("version_id")
    )
    child = chunks.where(F.col("kind") == "child").select(
        "chunk_id", "version_id", "parent_chunk_id", "ordinal", "heading_path", "content"
    )
    own = F.coalesce("parent_chunk_id", "chunk_id")
    at = child.join(broadcast_if_small(hits), "chunk_id").withColumn("parent_chunk_id", own)
    found = pinned(at.join(active, "version_id"))
    wanted = broadcast_if_small(found.select("parent_chunk_id").distinct())
    parents = chunks.where(F.col("kind") == "parent").select(
        F.col("chunk_id").alias("parent_chunk_id"), F.col("content").alias("parent_content")
    )
    return (
        found.join(parents.join(wanted, "parent_chunk_id", "left_semi"), "parent_chunk_id", "left")
        .withColumn("content", F.coalesce("parent_content", "content"))
        .drop("parent_content")
    )


def sources(hydrated: DataFrame, *, deduplicate_parents: bool) -> DataFrame:
    """First hit per parent, then excerpts under the running character budget, then ranks 1..n."""
    by_query = Window.partitionBy("query_id")
    rows = hydrated
    if deduplicate_parents:
        per_parent = Window.partitionBy("query_id", "parent_chunk_id").orderBy("position")
        rows = rows.withColumn("_nth", F.row_number().over(per_parent)).where("_nth = 1").drop("_nth")
    ordered = by_query.orderBy("position")
    full = F.least(F.length("content"), F.lit(EXCERPT_CHARACTERS))
    spent = F.coalesce(
        F.sum(full).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    rows = rows.withColumn("_left", F.lit(EXCERPT_BUDGET) - spent).where("_left > 0")
    cut = F.substring(
        "content", F.lit(1), F.least(F.col("_left"), F.lit(EXCERPT_CHARACTERS)).cast("int")
    )
    return rows.withColumn("excerpt", cut).withColumn("rank", F.row_number().over(ordered)).drop("_left")


def rerank(rows: DataFrame, scored: Column, limit: int) -> DataFrame:
    """Order by a score column, falling back to the fused order of a query with a failed score.

    A null score marks a failure: the whole query keeps its order and is marked degraded. Ranks are
    renumbered and cut afterwards.
    """
    by_query = Window.partitionBy("query_id")
    marked = rows.withColumn("_score", scored)
    failed = F.max(F.col("_score").isNull()).over(by_query) & (F.count(F.lit(1)).over(by_query) > 1)
    marked = marked.withColumn("degraded", failed)
    key = F.when(~F.col("degraded"), F.col("_score"))
    order = by_query.orderBy(F.desc_nulls_last(key), "rank")
    ranked = marked.withColumn("_new", F.row_number().over(order)).where(F.col("_new") <= limit)
    return ranked.withColumn("rank", F.col("_new")).drop("_new", "_score")


def cited(rows: DataFrame, limit: int) -> DataFrame:
    """First `limit` sources per query with citation marks `[n]`."""
    return rows.where(F.col("rank") <= limit).withColumn("citation_id", F.format_string("[%d]", "rank"))


def public_source(rows: DataFrame) -> DataFrame:
    """A source as the JSON object handed to clients, ids as strings."""
    fields = [
        "citation_id", "chunk_id", F.col("doc_id").cast("string").alias("document_id"),
        F.col("version_id").alias("document_version_id"), "title", "filename", "heading_path",
        "excerpt", "score", "rank",
    ]
    return rows.select("query_id", "rank", F.to_json(F.struct(*fields)).alias("source"))


def tool_status(queries: DataFrame, found: DataFrame) -> DataFrame:
    """One status row per query, queries without results included.

    `queries` carries `in_scope` and may carry `failed` for a search that did not run.
    """
    counts = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_sources"))
    failed = F.col("failed") if "failed" in queries.columns else F.lit(False)
    status = (
        F.when(~F.col("in_scope"), "knowledge_scope_unavailable")
        .when(failed, "retrieval_unavailable")
        .when(F.coalesce("n_sources", F.lit(0)) == 0, "no_relevant_knowledge")
        .otherwise("ok")
    )
    return queries.join(counts, "query_id", "left").select(
        "query_id",
        status.alias("status"),
        F.when(status == "ok", F.col("n_sources")).otherwise(F.lit(0)).cast("long").alias("n_sources"),
    )


def _visible_documents(documents: DataFrame, bases: DataFrame) -> DataFrame:
    return documents.where(~F.col("deleted") & F.col("active_version_id").isNotNull()).join(
        bases.where("enabled").select("kb_id"), "kb_id"
    )


def read_neighbours(
    hits: DataFrame, chunks: DataFrame, documents: DataFrame, bases: DataFrame
) -> DataFrame:
    """First three parents around each hit: its own and those within two ordinals.

    `hits` is (request_id, chunk_id). The range condition runs inside one version, joined by id.
    """
    active = _visible_documents(documents, bases).select(
        "doc_id", "title", F.col("active_version_id").alias("version_id")
    )
    at = (
        hits.join(chunks.select("chunk_id", "version_id", "ordinal", "parent_chunk_id"), "chunk_id")
        .join(active, "version_id")
        .select(
            "request_id",
            "doc_id",
            "title",
            "version_id",
            F.coalesce("parent_chunk_id", "chunk_id").alias("own_parent"),
            F.col("ordinal").alias("at"),
        )
    )
    parents = chunks.where(F.col("kind") == "parent").select(
        "version_id", "chunk_id", "ordinal", "content", "heading_path"
    )
    near = (F.col("chunk_id") == F.col("own_parent")) | F.col("ordinal").between(
        F.greatest(F.lit(0), F.col("at") - NEIGHBOUR_SPAN), F.col("at") + NEIGHBOUR_SPAN
    )
    around = at.join(parents, "version_id").where(near)
    ranked = top_k(around, ["request_id"], ["ordinal"], READ_LIMIT)
    return ranked.withColumn("excerpt", T.excerpt(F.col("content"), READ_CHARACTERS)).drop(
        "content", "own_parent", "at"
    )


def read_document_head(chunks: DataFrame, documents: DataFrame, bases: DataFrame) -> DataFrame:
    """First three parents of every visible document's active version.

    Parents of a version carry their ordinals, so the cut needs only the ordinals of three parents;
    the window limits each document before rows move.
    """
    active = _visible_documents(documents, bases).select(
        "doc_id", "kb_id", "title", F.col("active_version_id").alias("version_id")
    )
    parents = chunks.where(F.col("kind") == "parent").select(
        "version_id", "chunk_id", "ordinal", T.excerpt(F.col("content"), READ_CHARACTERS).alias("excerpt")
    )
    heads = top_k(parents, ["version_id"], ["ordinal"], READ_LIMIT)
    return heads.join(active, "version_id")


def list_documents(
    documents: DataFrame, bases: DataFrame, *, title: str = "", limit: int = 20
) -> DataFrame:
    """Visible documents whose title or filename contains the text, by title and id."""
    if not 1 <= limit <= 20:
        raise ValueError("invalid_document_limit")
    rows = _visible_documents(documents, bases)
    needle = title.strip()
    if needle:
        rows = rows.where(
            T.contains_ignoring_case(F.col("title"), F.lit(needle))
            | T.contains_ignoring_case(F.col("filename"), F.lit(needle))
        )
    return rows.select("doc_id", "title", "filename").orderBy("title", "doc_id").limit(limit)
