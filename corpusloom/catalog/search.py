"""Registered wiki search, integrity and evaluation queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.catalog import retrieval
from corpusloom.catalog import sql as S
from corpusloom.catalog.wiki import CLAIMS, PAGES
from corpusloom.functions import text as T
from corpusloom.operators import containment, mmr
from corpusloom.plans import evaluate, integrity, page_model, retrieve, wiki_search
from corpusloom.plugins import token_overlap_score
from corpusloom.session import broadcast_if_small, pinned
from corpusloom.sources import search_index, tables, wiki_tables


def wiki_queries(spark: SparkSession, folder: str) -> DataFrame:
    return wiki_search.valid_queries(tables.query_sentences(spark, folder))


def query_validity(spark: SparkSession, folder: str) -> DataFrame:
    """Whole passages and their sentences as wiki queries; passages above 200 characters fall out."""
    whole = tables.queries(spark, folder).select((F.col("query_id") * 100 + 99).alias("query_id"), "text")
    asked = tables.query_sentences(spark, folder).select("query_id", "text").unionByName(whole)
    limit = (F.col("query_id") % 23).cast("int")
    return asked.select(
        "query_id",
        retrieve.query_status(F.col("text"), limit).alias("status"),
        T.short_digest(T.normalize_query(F.col("text"))).alias("fingerprint"),
    )


def metadata_channel(spark: SparkSession, folder: str) -> DataFrame:
    rows = wiki_search.metadata_channel(wiki_tables.wiki_pages(spark, folder), wiki_queries(spark, folder))
    return rows.select(
        "query_id", "page_id", "title_score", "summary_score", "alias_score", "exact_match",
        F.array_join("matched_fields", ",").alias("matched_fields"), F.col("position").cast("long").alias("position"),
    )


def trigram_title_match(spark: SparkSession, folder: str) -> DataFrame:
    """Fuzzy join of page headings and names to page titles, all bases."""
    pages = wiki_tables.wiki_pages(spark, folder).withColumns(
        {"enabled": F.lit(True), "wiki_enabled": F.lit(True)}
    )
    asked = pages.select(
        F.col("doc_id").alias("query_id"), T.normalize_query(F.col("title")).alias("query")
    ).where(F.size(T.terms(F.col("query"))) > 0)
    rows = wiki_search.metadata_channel(pages, asked)
    return rows.select(
        "query_id", "page_id", "relevance", "exact_match", F.col("position").cast("long").alias("position")
    )


def evidence(spark: SparkSession, folder: str, chunks: DataFrame | None = None) -> DataFrame:
    """Current evidence, written once: several steps read it. Searches give the `chunks` that their index holds."""
    chunks = tables.chunks(spark, folder) if chunks is None else chunks
    return pinned(
        integrity.current_evidence(
            wiki_tables.wiki_pages(spark, folder),
            wiki_tables.claims_of(spark, folder, chunks),
            wiki_tables.claim_sources_of(chunks),
            tables.documents_dim(spark, folder),
            chunks,
        )
    )


def indexed_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return evidence(spark, folder, search_index.of(spark, folder).chunks)


def sentence_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate sources of the wiki queries, written once: several steps read them."""
    asked = wiki_queries(spark, folder).select("query_id", F.col("query").alias("text"))
    hits = retrieve.hybrid_hits(
        None,
        tables.document_vectors(spark, folder),
        asked,
        wiki_tables.case_vectors(spark, folder),
        retrieve.candidate_pool(wiki_search.SOURCE_LIMIT),
        retrieval.enabled_bases(spark, folder),
        search_index.of(spark, folder),
    )
    found = retrieve.sources(retrieval.hydrated(spark, folder, hits), deduplicate_parents=False)
    return pinned(retrieve.cited(found, wiki_search.SOURCE_LIMIT).select("query_id", "chunk_id", "doc_id", "rank"))


def provenance_channel(spark: SparkSession, folder: str) -> DataFrame:
    rows = wiki_search.provenance_channel(sentence_sources(spark, folder), indexed_evidence(spark, folder))
    return rows.select(
        "query_id", "page_id", F.col("source_rank").cast("long").alias("source_rank"),
        F.col("position").cast("long").alias("position"),
    )


def scored_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Claims of the pages in the provenance channel, scored for its queries."""
    sources, facts = sentence_sources(spark, folder), indexed_evidence(spark, folder)
    asked = wiki_search.provenance_channel(sources, facts).join(
        wiki_queries(spark, folder).select("query_id", "query"), "query_id"
    )
    return wiki_search.score_claims(asked, facts, sources)


def claim_scores(spark: SparkSession, folder: str) -> DataFrame:
    return scored_claims(spark, folder).select(
        "query_id", "page_id", "claim_id", F.col("best_rank").cast("long").alias("best_rank"),
        F.round("relevance", 6).alias("relevance"),
    )


def mmr_claims(spark: SparkSession, folder: str) -> DataFrame:
    competing = pinned(
        wiki_search.claim_order_input(scored_claims(spark, folder)).withColumn("picks", F.lit(4))
    )
    return mmr.first_picks(competing, "picks").select("query_id", "page_id", "claim_id", "pick")


def wiki_search_budgeted(spark: SparkSession, folder: str) -> DataFrame:
    rows = searched(spark, folder)
    return rows.select(
        "query_id", "page_order", "page_id", "slug", "score", F.array_join("matched_fields", ",").alias("matched_fields"),
        "claim_rank", "claim_id", F.round("claim_score", 6).alias("claim_score"),
        F.col("omitted_claim_count").cast("long").alias("omitted_claim_count"), "truncation_reason",
    )


def searched(spark: SparkSession, folder: str) -> DataFrame:
    """Budgeted wiki search; the budgets are tight enough to cut results."""
    return wiki_search.search(*search_inputs(spark, folder), character_budget=700)


def search_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Queries, pages, evidence and candidate sources."""
    asked, pages = wiki_queries(spark, folder), wiki_tables.wiki_pages(spark, folder)
    return asked, pages, indexed_evidence(spark, folder), sentence_sources(spark, folder)


def wiki_search_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Wiki search at the documented budget; every matched claim with each of its valid sources."""
    asked, pages, facts, sources = search_inputs(spark, folder)
    found = pinned(wiki_search.search(asked, pages, facts, sources))
    cited = wiki_search.claim_sources(found, facts)
    rows = found.join(cited, ["query_id", "page_id", "claim_id"])
    return rows.select(
        "query_id", "page_order", "page_id", "claim_rank", "claim_id", F.round("claim_score", 6).alias("claim_score"),
        F.col("omitted_claim_count").cast("long").alias("omitted_claim_count"), "truncation_reason",
        F.col("source_no").cast("long").alias("source_no"), "chunk_id", "doc_id",
    )


def page_reranker(query: Column, passage: Column) -> Column:
    """The default reranker; it fails on passages with a certain pair of syllables."""
    return F.when(~F.lower(passage).contains("ouou"), token_overlap_score(query, passage))


def wiki_search_reranked(spark: SparkSession, folder: str) -> DataFrame:
    """Pages in the reranker's order; queries with a failed score keep the fused order and say so."""
    rows = wiki_search.search(*search_inputs(spark, folder), reranker=page_reranker)
    return rows.select(
        "query_id", "page_order", "page_id", "claim_rank", "claim_id", "degraded", "degradation_reason", "truncation_reason"
    )


def wiki_search_degraded(spark: SparkSession, folder: str) -> DataFrame:
    """One status row per query where every third one has no source channel and every third one no source reranker."""
    asked, pages, facts, sources = search_inputs(spark, folder)
    turn = F.col("query_id") % 3
    reason = F.when(turn == 0, wiki_search.SOURCES_UNAVAILABLE).when(turn == 1, "source_reranker_unavailable")
    failures = asked.select("query_id", reason.alias("reason")).where("reason IS NOT NULL")
    _, status = wiki_search.search_with_status(asked, pages, facts, sources, reranker=page_reranker, source_failures=failures)
    return status.select("query_id", "n_pages", "n_claims", "truncation_reason", "degraded", "degradation_reason")


def wiki_page_read(spark: SparkSession, folder: str) -> DataFrame:
    """Every page read twice: by position from a cursor, and ranked for its own title."""
    pages = wiki_tables.wiki_pages(spark, folder).where("enabled AND wiki_enabled")
    number = F.col("doc_id")
    plain = pages.select(
        (number * 2).alias("request_id"), "page_id", F.lit(" ").alias("query"),
        (number % 3).cast("int").alias("cursor"), F.lit(5).alias("limit"),
    )
    ranked = pages.select(
        (number * 2 + 1).alias("request_id"), "page_id", F.col("summary").alias("query"),
        F.lit(1).alias("cursor"), F.lit(3).alias("limit"),
    )
    rows = wiki_search.read_pages(plain.unionByName(ranked), evidence(spark, folder))
    return rows.select("request_id", "page_id", "claim_id", "place", "next_cursor", "omitted_claim_count")


def checked_sources(spark: SparkSession, folder: str) -> DataFrame:
    return integrity.source_validity(
        wiki_tables.claim_sources(spark, folder),
        tables.documents_dim(spark, folder),
        tables.chunks(spark, folder),
    )


def source_validity(spark: SparkSession, folder: str) -> DataFrame:
    return checked_sources(spark, folder).select(
        "claim_id", "chunk_id", F.col("chunk_ordinal").cast("long").alias("chunk_ordinal"), "valid"
    )


def claim_trust_display(spark: SparkSession, folder: str) -> DataFrame:
    rows = integrity.displayed_trust(wiki_tables.claims(spark, folder), checked_sources(spark, folder))
    return rows.select("claim_id", "trust_state", "displayed", "display_reason", "n_sources", "n_valid")


def wiki_page_model(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's nested model, its entries written out: claim, trust, sources with their validity."""
    rows = page_model.page_model(
        wiki_tables.wiki_pages(spark, folder), wiki_tables.claims(spark, folder), checked_sources(spark, folder), 20, 4
    )
    source = lambda s: F.concat_ws(":", s["doc_id"], s["chunk_ordinal"], s["chunk_id"], s["valid"].cast("string"))
    entry = lambda c: F.concat_ws(
        "|", c["claim_id"], c["position"], c["trust_state"], F.coalesce(c["reason"], F.lit("-")), c["n_sources"],
        c["source_part"], T.short_digest(c["text"]), F.array_join(F.transform(c["sources"], source), ","),
    )
    return rows.select(
        "page_id", "slug", "part_no", F.size("claims").cast("long").alias("n_entries"),
        F.array_join(F.transform("claims", entry), ";").alias("model"),
    )


def claims_admissible(spark: SparkSession, folder: str) -> DataFrame:
    rows = integrity.admissible_claims(wiki_tables.claims(spark, folder), checked_sources(spark, folder))
    return rows.select("claim_id", "page_id", F.col("position").cast("long").alias("position"))


def claims_invalidated(spark: SparkSession, folder: str) -> DataFrame:
    changed = tables.documents_dim(spark, folder).where("deleted OR active_version_id LIKE '%-v2'")
    rows = integrity.invalidate_claims(
        wiki_tables.claims(spark, folder), wiki_tables.claim_sources(spark, folder), changed
    )
    return rows.select("claim_id", "trust_state", "reason")


def constraint_report(spark: SparkSession, folder: str) -> DataFrame:
    """Uniqueness and allowed values over given and derived tables, with known violations."""
    docs = tables.read(spark, folder, "documents", spread=True)
    digests = docs.select("source", T.sha256_hex(F.col("text")).alias("sha256"))
    chunks = tables.chunks(spark, folder)
    aliases = wiki_tables.alias_rows(spark, folder).select("page_id", T.normalize_alias(F.col("alias")).alias("alias"))
    return integrity.constraint_report(
        [
            integrity.unique_violations(digests, ["source", "sha256"], "uq_documents_base_sha256"),
            integrity.unique_violations(chunks, ["version_id", "ordinal", "kind"], "uq_chunks_version_ordinal_kind"),
            integrity.unique_violations(aliases, ["page_id", "alias"], "uq_wiki_page_aliases"),
            integrity.unique_violations(
                tables.read(spark, folder, "pages").select("url"), ["url"], "uq_pages_url"
            ),
            integrity.allowed_violations(
                wiki_tables.claims(spark, folder), "claim_type", ("topic_fact", "manual"), "ck_claim_type"
            ),
            integrity.allowed_violations(
                tables.read(spark, folder, "conversations"), "role", ("user", "assistant"), "ck_role"
            ),
        ]
    )


def expected(spark: SparkSession, folder: str) -> DataFrame:
    return containment.containing(
        tables.queries(spark, folder), tables.read(spark, folder, "documents", spread=True)
    )


def keyword_public(spark: SparkSession, folder: str) -> DataFrame:
    hits = retrieval.keyword_hits(spark, folder, retrieve.PUBLIC_POOL)
    found = retrieve.sources(retrieval.hydrated(spark, folder, hits), deduplicate_parents=True)
    return retrieve.cited(found, retrieve.PUBLIC_LIMIT)


def eval_recall_mrr(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.recall_and_mrr(evaluate.best_ranks(keyword_public(spark, folder), expected(spark, folder)))


def eval_no_answer(spark: SparkSession, folder: str) -> DataFrame:
    asked = tables.queries(spark, folder)
    unanswerable = asked.join(expected(spark, folder), "query_id", "left_anti")
    return evaluate.false_answers(unanswerable, keyword_public(spark, folder))


def eval_page_recall(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.page_recall(keyword_public(spark, folder), expected(spark, folder))


def query_terms(spark: SparkSession, folder: str, length: int) -> DataFrame:
    """Expected terms of a passage: its words of at least `length` letters."""
    words = F.filter(T.token_set(F.col("text")), lambda w: F.length(w) >= length)
    return tables.queries(spark, folder).select("query_id", F.explode(words).alias("term"))


def eval_term_recall(spark: SparkSession, folder: str) -> DataFrame:
    rendered = keyword_public(spark, folder).select("query_id", F.col("excerpt").alias("text"))
    return evaluate.term_recall(rendered, query_terms(spark, folder, 8))


def eval_citation_precision(spark: SparkSession, folder: str) -> DataFrame:
    citations = keyword_public(spark, folder).select(
        "query_id", F.col("chunk_id").alias("claim_id"), F.col("excerpt").alias("text"), "doc_id"
    )
    return evaluate.citation_precision(citations, query_terms(spark, folder, 10), expected(spark, folder))


def eval_consistency(spark: SparkSession, folder: str) -> DataFrame:
    """Agreement of the sentences of a passage on the documents they find."""
    cases = tables.query_sentences(spark, folder).join(
        wiki_queries(spark, folder).select("query_id"), "query_id", "left_semi"
    ).select("case_id", "query_id")
    return evaluate.paraphrase_consistency(sentence_sources(spark, folder), cases)


def eval_no_match(spark: SparkSession, folder: str) -> DataFrame:
    """Wiki queries of passages no document holds: how often claims come back, and forbidden words."""
    found = pinned(searched(spark, folder).select("query_id", "claim_id"))
    answerable = expected(spark, folder).select(F.col("query_id").alias("case_id")).distinct()
    asked = wiki_queries(spark, folder)
    unanswerable = asked.join(answerable, "case_id", "left_anti").select("query_id")
    claims = wiki_tables.claims_of(spark, folder, search_index.of(spark, folder).chunks).select("claim_id", "text")
    texts = claims.join(broadcast_if_small(found), "claim_id")
    words = F.filter(T.token_set(F.col("text")), lambda w: F.length(w) >= 12)
    forbidden = asked.select("query_id", F.explode(words).alias("term"))
    return evaluate.false_matches(unanswerable, found, texts, forbidden)


def eval_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Leaks if search returned every claim citing a found source instead of the admissible ones."""
    chunks = search_index.of(spark, folder).chunks
    sources = wiki_tables.claim_sources_of(chunks)
    found = broadcast_if_small(sentence_sources(spark, folder).select("chunk_id"))
    ids = broadcast_if_small(sources.join(found, "chunk_id").select("claim_id").distinct())
    claims = wiki_tables.claims_of(spark, folder, chunks).join(ids, "claim_id", "left_semi")
    checked = integrity.narrowed_validity(
        sources.join(ids, "claim_id", "left_semi"), tables.documents_dim(spark, folder), chunks
    )
    return evaluate.leak_counts(ids, claims, checked)


QUERIES = {
    "query_validity": query_validity,
    "metadata_channel": metadata_channel,
    "trigram_title_match": trigram_title_match,
    "provenance_channel": provenance_channel,
    "claim_scores": claim_scores,
    "mmr_claims": mmr_claims,
    "wiki_search_budgeted": wiki_search_budgeted,
    "wiki_search_sources": wiki_search_sources,
    "wiki_search_reranked": wiki_search_reranked,
    "wiki_search_degraded": wiki_search_degraded,
    "wiki_page_read": wiki_page_read,
    "source_validity": source_validity,
    "claim_trust_display": claim_trust_display,
    "wiki_page_model": wiki_page_model,
    "claims_admissible": claims_admissible,
    "claims_invalidated": claims_invalidated,
    "constraint_report": constraint_report,
    "eval_recall_mrr": eval_recall_mrr,
    "eval_no_answer": eval_no_answer,
    "eval_page_recall": eval_page_recall,
    "eval_term_recall": eval_term_recall,
    "eval_citation_precision": eval_citation_precision,
    "eval_consistency": eval_consistency,
    "eval_no_match": eval_no_match,
    "eval_leaks": eval_leaks,
}

SENTENCES = """
sentence_rows AS (
  SELECT item_id, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS pos
  FROM (SELECT item_id, list_filter(list_transform(string_split_regex(text, '[.!?]'),
                 lambda s: trim(replace(s, chr(10), ' '))), lambda s: s <> '') AS parts FROM benchmark)),
query_sentences AS (SELECT item_id * 100 + pos AS query_id, item_id AS case_id, text FROM sentence_rows)"""

NORMAL = "regexp_replace(replace(lower(trim({0})), 'ß', 'ss'), '\\s+', ' ', 'g')"
NORMALIZED = f"""
asked AS (
  SELECT query_id, case_id, {NORMAL.format('text')} AS query FROM query_sentences
  WHERE length({NORMAL.format('text')}) BETWEEN 1 AND 200
        AND regexp_matches({NORMAL.format('text')}, '[a-z0-9㐀-鿿]'))"""

GRAMS = (
    "list_distinct(flatten(list_transform(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'), lambda w: "
    "list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
)
SIMILARITY = (
    "CASE WHEN len({0}) + len({1}) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1})) / "
    "(len({0}) + len({1}) - len(list_intersect({0}, {1}))) END"
)


def metadata_sql(asked: str, pages: str) -> str:
    return f"""
query_grams AS (SELECT query_id, query, replace(query, ' ', '-') AS slug_query, {GRAMS.format('query')} AS qg FROM {asked}),
page_grams AS (
  SELECT page_id, lower(title) AS t, lower(slug) AS s, list_transform(aliases, lambda a: lower(a)) AS low_aliases,
         {GRAMS.format('title')} AS tg, {GRAMS.format('summary')} AS sg,
         list_transform(aliases, lambda a: {GRAMS.format('a')}) AS ag
  FROM {pages}),
field_scores AS (
  SELECT query_id, page_id, round({SIMILARITY.format('tg', 'qg')}, 6) AS title_score,
         round({SIMILARITY.format('sg', 'qg')}, 6) AS summary_score,
         round(coalesce(list_max(list_transform(ag, lambda g: {SIMILARITY.format('g', 'qg')})), 0.0), 6) AS alias_score,
         starts_with(s, slug_query) AS slug_matched,
         t = query OR s = slug_query OR list_contains(low_aliases, query) AS exact_match
  FROM query_grams, page_grams),
field_cut AS (
  SELECT *, greatest(title_score, summary_score, alias_score) AS relevance FROM field_scores
  WHERE greatest(title_score, summary_score, alias_score) > 0.1 OR slug_matched
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY exact_match DESC, slug_matched DESC,
            greatest(title_score, summary_score, alias_score) DESC, page_id) <= 200),
metadata AS (
  SELECT *, concat_ws(',', CASE WHEN title_score > 0.1 THEN 'title' END, CASE WHEN summary_score > 0.1 THEN 'summary' END,
                      CASE WHEN alias_score > 0.1 THEN 'alias' END, CASE WHEN slug_matched THEN 'slug' END) AS matched_fields,
         row_number() OVER (PARTITION BY query_id ORDER BY exact_match DESC, relevance DESC, page_id) AS position
  FROM field_cut QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY exact_match DESC, relevance DESC, page_id) <= 40)"""


SEARCHABLE = "searchable AS (SELECT * FROM wiki_pages WHERE enabled AND wiki_enabled)"

CHECKED = """
checked AS (
  SELECT s.*, coalesce(d.active_version_id = s.version_id AND NOT d.deleted AND d.status = 'ready'
                       AND sha256(c.content) = s.content_sha256, false) AS valid
  FROM claim_sources s LEFT JOIN documents_dim d USING (doc_id)
       LEFT JOIN chunks c ON c.version_id = s.version_id AND c.kind = s.chunk_kind AND c.ordinal = s.chunk_ordinal)"""

EVIDENCE = """
evidence AS MATERIALIZED (
  SELECT c.page_id, c.claim_id, c.text, c.position, s.chunk_id
  FROM claims c JOIN checked s USING (claim_id) JOIN searchable p ON p.page_id = c.page_id
       JOIN documents_dim d ON d.doc_id = s.doc_id AND d.kb_id = p.kb_id
  WHERE s.valid AND c.trust_state = 'verified')"""

SOURCE_PARTS = (
    S.BASES, S.DIM, S.CHUNKS, SENTENCES, NORMALIZED,
    "queries AS (SELECT query_id, query AS text FROM asked)",
    S.KEYWORD,
    S.DENSE.replace(
        "SELECT b.item_id AS query_id, CAST(e.embedding AS DOUBLE[]) AS vector\n"
        "  FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id",
        "SELECT b.query_id, CAST(e.embedding AS DOUBLE[]) AS vector\n"
        "  FROM asked b JOIN embeddings e ON e.vec_id = b.case_id",
    ),
    S.HYBRID, retrieval.VISIBLE,
    "pool AS (SELECT query_id, chunk_id, score, rank AS position FROM fused WHERE rank <= 80)",
    retrieval.hydrate_sql("pool", deduplicate=False),
    "sources AS MATERIALIZED (SELECT query_id, chunk_id, doc_id, rank FROM sourced WHERE rank <= 40)",
)
EVIDENCE_PARTS = (PAGES, CLAIMS, CHECKED, SEARCHABLE, EVIDENCE)

PROVENANCE = """
provenance AS (
  SELECT query_id, page_id, source_rank, row_number() OVER (PARTITION BY query_id ORDER BY source_rank, page_id) AS position
  FROM (SELECT s.query_id, e.page_id, min(s.rank) AS source_rank
        FROM sources s JOIN evidence e USING (chunk_id) GROUP BY ALL))"""


def scored_sql(pairs: str) -> str:
    tokens = "list_distinct(regexp_extract_all(" + NORMAL + ", '[a-z0-9]+|[㐀-鿿]'))"
    return f"""
scored AS MATERIALIZED (
  SELECT query_id, page_id, claim_id, text, position, best_rank,
         coalesce(1.0::DOUBLE / best_rank, 0.0::DOUBLE) + len(list_intersect(qt, tt)) / len(qt) AS relevance,
         list_distinct({S.TERMS.format('text')}) AS tokens
  FROM (SELECT a.query_id, a.page_id, e.claim_id, any_value(e.text) AS text, any_value(e.position) AS position,
               min(s.rank) AS best_rank, {tokens.format('any_value(q.query)')} AS qt, {tokens.format('any_value(e.text)')} AS tt
        FROM {pairs} a JOIN asked q ON q.query_id = a.query_id JOIN evidence e ON e.page_id = a.page_id
             LEFT JOIN sources s ON s.query_id = a.query_id AND s.chunk_id = e.chunk_id
        GROUP BY a.query_id, a.page_id, e.claim_id))"""


def mmr_sql(limit: str) -> str:
    """Greedy order by recursion; `limit` is an expression on the group's row."""
    return f"""
mmr_groups AS MATERIALIZED (SELECT DISTINCT query_id, page_id, {limit} AS picks FROM scored),
mmr_walk(query_id, page_id, picks, n, claim_id, chosen, token_sets) AS (
  SELECT query_id, page_id, picks, 0, '', []::VARCHAR[], []::VARCHAR[][] FROM mmr_groups
  UNION ALL
  SELECT query_id, page_id, picks, n + 1, best.claim_id, list_append(chosen, best.claim_id), list_append(token_sets, best.tokens)
  FROM (SELECT w.query_id, w.page_id, w.picks, w.n, w.chosen, w.token_sets,
               arg_min(struct_pack(claim_id := c.claim_id, tokens := c.tokens), struct_pack(v := -(CASE WHEN w.n = 0
                 THEN c.relevance ELSE 0.7::DOUBLE * c.relevance - (1 - 0.7::DOUBLE) * list_max(list_transform(w.token_sets,
                   lambda s: CASE WHEN len(s) + len(c.tokens) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(s, c.tokens))
                     / (len(s) + len(c.tokens) - len(list_intersect(s, c.tokens))) END)) END),
                 p := c.position, i := c.claim_id)) AS best
        FROM mmr_walk w JOIN scored c USING (query_id, page_id)
        WHERE w.n < w.picks AND NOT list_contains(w.chosen, c.claim_id)
        GROUP BY w.query_id, w.page_id, w.picks, w.n, w.chosen, w.token_sets)),
picked AS (SELECT query_id, page_id, claim_id, n AS pick FROM mmr_walk WHERE n > 0)"""


FUSED_PAGES = """
page_channels AS (
  SELECT query_id, 1 AS channel, page_id, position FROM metadata
  UNION ALL SELECT query_id, 2, page_id, position FROM provenance),
page_fused AS (
  SELECT f.*, row_number() OVER (PARTITION BY f.query_id ORDER BY f.score DESC, f.first_seen, f.page_id) AS page_order
  FROM (SELECT query_id, page_id, round(sum(1.0 / (60 + position)), 8) AS score, min(channel * 1000 + position) AS first_seen
        FROM page_channels GROUP BY query_id, page_id) f JOIN searchable USING (page_id)),
page_counts AS (SELECT query_id, count(*) AS n_pages FROM page_fused GROUP BY 1)"""

BUDGET_FOLD = """
walk_rows AS MATERIALIZED (
  SELECT f.query_id, f.page_order, f.page_id, p.pick, p.claim_id, length(s.text) AS cost, s.relevance, c.n_pages,
         CASE WHEN c.n_pages = 1 THEN 12 ELSE 4 END AS per_page,
         row_number() OVER (PARTITION BY f.query_id ORDER BY f.page_order, p.pick) AS n,
         coalesce(lead(f.page_order) OVER (PARTITION BY f.query_id ORDER BY f.page_order, p.pick), 0) <> f.page_order AS last_of_page
  FROM page_fused f JOIN page_counts c USING (query_id) LEFT JOIN picked p USING (query_id, page_id)
       LEFT JOIN scored s ON s.query_id = f.query_id AND s.page_id = f.page_id AND s.claim_id = p.claim_id),
budget(query_id, n, page_order, stopped, page_open, taken, found, claims_left, chars_left, reason, took) AS (
  SELECT DISTINCT query_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), false, false, 0, 0, 12, CAST(700 AS BIGINT),
         CAST(NULL AS VARCHAR), false FROM walk_rows
  UNION ALL
  SELECT query_id, n, page_order,
         stop1 OR (last_of_page AND open1 IS NOT NULL AND taken2 > 0 AND chars2 <= 0),
         open2, taken2, found1 + CASE WHEN last_of_page AND NOT stop1 AND taken2 > 0 THEN 1 ELSE 0 END,
         claims2, chars2,
         CASE WHEN stop1 THEN reason1 WHEN last_of_page AND taken2 > 0 AND chars2 <= 0 THEN 'character_budget' ELSE reason2 END,
         took
  FROM (
    SELECT *, taken1 + CASE WHEN took THEN 1 ELSE 0 END AS taken2, claims1 - CASE WHEN took THEN 1 ELSE 0 END AS claims2,
           CASE WHEN took THEN greatest(0, chars1 - cost) ELSE chars1 END AS chars2,
           open1 AND NOT blocked AND NOT full_page AS open2,
           CASE WHEN NOT stop1 AND open1 AND NOT full_page AND blocked THEN 'character_budget' ELSE reason1 END AS reason2
    FROM (
      SELECT *, NOT stop1 AND open1 AND pick IS NOT NULL AND NOT full_page AND NOT blocked AS took FROM (
        SELECT *, taken1 >= per_page OR claims1 <= 0 AS full_page,
               coalesce(cost > chars1 AND (taken1 > 0 OR found1 > 0), false) AS blocked
        FROM (
          SELECT r.*, b.stopped OR (r.page_order <> b.page_order AND (b.found >= 5 OR b.claims_left <= 0)) AS stop1,
                 r.page_order <> b.page_order OR b.page_open AS open1,
                 CASE WHEN r.page_order <> b.page_order THEN 0 ELSE b.taken END AS taken1, b.found AS found1,
                 b.claims_left AS claims1, b.chars_left AS chars1,
                 CASE WHEN NOT b.stopped AND r.page_order <> b.page_order AND (b.found >= 5 OR b.claims_left <= 0)
                      THEN coalesce(b.reason, 'claim_limit') ELSE b.reason END AS reason1
          FROM budget b JOIN walk_rows r ON r.query_id = b.query_id AND r.n = b.n + 1))))),
final_state AS (
  SELECT b.query_id, coalesce(b.reason, CASE WHEN b.found < c.n_pages THEN CASE WHEN b.found >= 5 THEN 'page_limit'
           ELSE 'claim_limit' END END) AS truncation_reason
  FROM budget b JOIN page_counts c USING (query_id)
  QUALIFY row_number() OVER (PARTITION BY b.query_id ORDER BY b.n DESC) = 1),
returned AS (
  SELECT r.*, row_number() OVER (PARTITION BY r.query_id, r.page_id ORDER BY r.pick) AS claim_rank,
         count(*) OVER (PARTITION BY r.query_id, r.page_id) AS shown
  FROM budget b JOIN walk_rows r USING (query_id, n) WHERE b.took)"""

RERANKED_PAGES = FUSED_PAGES.replace("page_fused AS", "page_first AS").split("page_counts AS")[0] + f"""
passages AS (
  SELECT p.page_id, title || chr(10) || array_to_string(aliases, ' ') || chr(10) || coalesce(summary, '') || chr(10) || coalesce(c.text, '') AS passage
  FROM searchable p LEFT JOIN (SELECT page_id, arg_min(text, struct_pack(a := position, b := claim_id)) AS text
                               FROM evidence GROUP BY 1) c USING (page_id)),
page_scores AS (
  SELECT f.*, contains(lower(passage), 'ouou') AS broken, list_distinct({S.TERMS.format('query')}) AS qt,
         list_distinct({S.TERMS.format('passage')}) AS pt
  FROM page_first f JOIN asked USING (query_id) JOIN passages USING (page_id)),
page_marked AS (
  SELECT *, bool_or(broken) OVER (PARTITION BY query_id) AND count(*) OVER (PARTITION BY query_id) > 1 AS failed,
         CASE WHEN NOT broken THEN round(len(list_intersect(qt, pt)) / len(qt), 6) END AS judged FROM page_scores),
page_fused AS (
  SELECT query_id, page_id, score, failed, row_number() OVER (PARTITION BY query_id
           ORDER BY CASE WHEN NOT failed THEN judged END DESC NULLS LAST, page_order) AS page_order FROM page_marked),
page_counts AS (SELECT query_id, count(*) AS n_pages FROM page_fused GROUP BY 1)"""


def search_parts(budget: int, pages: str = FUSED_PAGES, sources: tuple[str, ...] = SOURCE_PARTS) -> tuple[str, ...]:
    """Common table expressions of a wiki search at a character budget."""
    picks = "(SELECT CASE WHEN c.n_pages = 1 THEN 12 ELSE 4 END FROM page_counts c WHERE c.query_id = scored.query_id)"
    return (
        *sources, *EVIDENCE_PARTS, PROVENANCE, metadata_sql("asked", "searchable"), pages, scored_sql("page_fused"),
        mmr_sql(picks), BUDGET_FOLD.replace("CAST(700 AS BIGINT)", f"CAST({budget} AS BIGINT)"),
    )


SEARCH_PARTS = search_parts(700)
WITHOUT_SOURCES = (
    *SOURCE_PARTS[:-1], SOURCE_PARTS[-1].replace("WHERE rank <= 40)", "WHERE rank <= 40 AND query_id % 3 <> 0)")
)

EXPECTED = """
expected AS (
  SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""

PUBLIC_PARTS = (
    *retrieval.BASE_PARTS, S.KEYWORD, retrieval.VISIBLE,
    "pool AS (SELECT query_id, chunk_id, score, position FROM keyword_ranked WHERE position <= 20)",
    retrieval.hydrate_sql("pool"),
    "results AS (SELECT query_id, chunk_id, doc_id, excerpt, rank FROM sourced WHERE rank <= 8)",
    EXPECTED,
)

CLAIM_PARTS = (S.BASES, S.DIM, S.CHUNKS, CLAIMS, CHECKED)

READ = """
facts AS (SELECT page_id, claim_id, any_value(text) AS text, any_value(position) AS position FROM evidence GROUP BY ALL),
totals AS (SELECT page_id, count(*) AS n FROM facts GROUP BY 1),
plain AS (
  SELECT request_id, page_id, claim_id, cursor, lim,
         row_number() OVER (PARTITION BY request_id ORDER BY position, claim_id) AS place
  FROM (SELECT doc_id * 2 AS request_id, page_id, doc_id % 3 AS cursor, 5 AS lim FROM searchable
        UNION ALL SELECT doc_id * 2 + 1, page_id, 1, 3 FROM searchable WHERE trim(summary) = '') JOIN facts USING (page_id)),
asked AS (SELECT doc_id * 2 + 1 AS query_id, page_id, """ + NORMAL.format("summary") + """ AS query FROM searchable
          WHERE trim(summary) <> ''),
sources AS (SELECT query_id, '' AS chunk_id, 1 AS rank FROM asked)"""

SQL = {
    "query_validity": S.sql(
        SENTENCES,
        f"""all_queries AS (
  SELECT query_id, {NORMAL.format('text')} AS query FROM (
    SELECT query_id, text FROM query_sentences UNION ALL SELECT item_id * 100 + 99, text FROM benchmark))""",
        select="""
SELECT query_id, CASE WHEN query = '' OR length(query) > 200 OR NOT regexp_matches(query, '[a-z0-9㐀-鿿]') THEN 'invalid_wiki_query'
         WHEN query_id % 23 NOT BETWEEN 1 AND 20 THEN 'invalid_search_options' ELSE 'ok' END AS status,
       substr(sha256(query), 1, 16) AS fingerprint
FROM all_queries""",
    ),
    "metadata_channel": S.sql(
        S.BASES, S.DIM, PAGES, SENTENCES, NORMALIZED, SEARCHABLE, metadata_sql("asked", "searchable"),
        select="""
SELECT query_id, page_id, title_score, summary_score, alias_score, exact_match, matched_fields, position FROM metadata""",
    ),
    "trigram_title_match": S.sql(
        S.BASES, S.DIM, PAGES,
        f"""titles AS (
  SELECT doc_id AS query_id, {NORMAL.format('title')} AS query FROM wiki_pages
  WHERE regexp_matches({NORMAL.format('title')}, '[a-z0-9㐀-鿿]'))""",
        metadata_sql("titles", "wiki_pages"),
        select="SELECT query_id, page_id, relevance, exact_match, position FROM metadata",
    ),
    "provenance_channel": S.sql(
        *SOURCE_PARTS, *EVIDENCE_PARTS, PROVENANCE,
        select="SELECT query_id, page_id, source_rank, position FROM provenance",
    ),
    "claim_scores": S.sql(
        *SOURCE_PARTS, *EVIDENCE_PARTS, PROVENANCE, scored_sql("provenance"),
        select="SELECT query_id, page_id, claim_id, best_rank, round(relevance, 6) AS relevance FROM scored",
    ),
    "mmr_claims": S.sql(
        *SOURCE_PARTS, *EVIDENCE_PARTS, PROVENANCE, scored_sql("provenance"), mmr_sql("4"),
        select="SELECT query_id, page_id, claim_id, CAST(pick AS BIGINT) AS pick FROM picked", recursive=True,
    ),
    "wiki_search_budgeted": S.sql(
        *SEARCH_PARTS,
        select="""
SELECT r.query_id, r.page_order, r.page_id, p.slug, f.score,
       concat_ws(',', nullif(m.matched_fields, ''), CASE WHEN v.page_id IS NOT NULL THEN 'source_chunk' END) AS matched_fields,
       r.claim_rank, r.claim_id, round(r.relevance, 6) AS claim_score,
       (SELECT count(*) FROM scored s WHERE s.query_id = r.query_id AND s.page_id = r.page_id) - r.shown AS omitted_claim_count,
       t.truncation_reason
FROM returned r JOIN page_fused f USING (query_id, page_id) JOIN searchable p USING (page_id) JOIN final_state t USING (query_id)
     LEFT JOIN metadata m USING (query_id, page_id) LEFT JOIN provenance v USING (query_id, page_id)""",
        recursive=True,
    ),
    "wiki_search_sources": S.sql(
        *search_parts(12_000),
        """cited AS (
  SELECT *, row_number() OVER (PARTITION BY page_id, claim_id ORDER BY doc_id, chunk_id) AS source_no
  FROM (SELECT DISTINCT e.page_id, e.claim_id, s.chunk_id, s.doc_id FROM evidence e JOIN claim_sources s USING (claim_id, chunk_id)))""",
        select="""
SELECT r.query_id, r.page_order, r.page_id, r.claim_rank, r.claim_id, round(r.relevance, 6) AS claim_score,
       (SELECT count(*) FROM scored s WHERE s.query_id = r.query_id AND s.page_id = r.page_id) - r.shown AS omitted_claim_count,
       t.truncation_reason, c.source_no, c.chunk_id, c.doc_id
FROM returned r JOIN final_state t USING (query_id) JOIN cited c ON c.page_id = r.page_id AND c.claim_id = r.claim_id""",
        recursive=True,
    ),
    "wiki_search_reranked": S.sql(
        *search_parts(12_000, RERANKED_PAGES),
        select="""
SELECT r.query_id, r.page_order, r.page_id, r.claim_rank, r.claim_id, f.failed AS degraded,
       CASE WHEN f.failed THEN 'reranker_unavailable' END AS degradation_reason, t.truncation_reason
FROM returned r JOIN page_fused f USING (query_id, page_id) JOIN final_state t USING (query_id)""",
        recursive=True,
    ),
    "wiki_search_degraded": S.sql(
        *search_parts(12_000, RERANKED_PAGES, WITHOUT_SOURCES),
        """reasons AS (
  SELECT query_id, CASE WHEN query_id % 3 = 0 THEN 'source_retrieval_unavailable'
                        WHEN query_id % 3 = 1 THEN 'source_reranker_unavailable'
                        WHEN query_id IN (SELECT query_id FROM page_fused WHERE failed) THEN 'reranker_unavailable' END AS reason
  FROM asked)""",
        select="""
SELECT q.query_id, coalesce(r.n_pages, 0) AS n_pages, coalesce(r.n_claims, 0) AS n_claims, t.truncation_reason,
       q.reason IS NOT NULL AS degraded, q.reason AS degradation_reason
FROM reasons q LEFT JOIN final_state t USING (query_id)
     LEFT JOIN (SELECT query_id, count(DISTINCT page_id) AS n_pages, count(*) AS n_claims FROM returned GROUP BY 1) r USING (query_id)""",
        recursive=True,
    ),
    "wiki_page_read": S.sql(
        S.BASES, S.DIM, S.CHUNKS, *EVIDENCE_PARTS, READ, scored_sql("asked"), mmr_sql("4"),
        select="""
SELECT request_id, page_id, claim_id, place, CASE WHEN cursor + lim < n THEN cursor + lim END AS next_cursor,
       greatest(0, n - cursor - lim) AS omitted_claim_count
FROM (SELECT * FROM plain UNION ALL SELECT query_id, page_id, claim_id, 1, 3, pick FROM picked) JOIN totals USING (page_id)
WHERE place > cursor AND place <= cursor + lim""",
        recursive=True,
    ),
    "source_validity": S.sql(*CLAIM_PARTS, select="SELECT claim_id, chunk_id, chunk_ordinal, valid FROM checked"),
    "claim_trust_display": S.sql(
        *CLAIM_PARTS,
        """rolled AS (SELECT claim_id, count(*) AS n_sources, count(*) FILTER (valid) AS n_valid FROM checked GROUP BY 1),
shown AS (
  SELECT c.claim_id, c.trust_state, coalesce(n_sources, 0) AS n_sources, coalesce(n_valid, 0) AS n_valid,
         c.trust_state = 'verified' AND n_sources > 0 AND n_sources = n_valid AS ok
  FROM claims c LEFT JOIN rolled USING (claim_id))""",
        select="""
SELECT claim_id, trust_state, CASE WHEN ok THEN 'verified' ELSE 'needs_review' END AS displayed,
       CASE WHEN NOT coalesce(ok, false) THEN 'source_not_current' END AS display_reason, n_sources, n_valid
FROM shown""",
    ),
    "wiki_page_model": S.sql(
        *CLAIM_PARTS, PAGES,
        """numbered_sources AS (
  SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY doc_id, version_id, chunk_ordinal, chunk_id) AS no FROM checked),
source_parts AS (
  SELECT claim_id, (no - 1) // 4 AS source_part,
         string_agg(doc_id || ':' || chunk_ordinal || ':' || chunk_id || ':' || valid, ',' ORDER BY no) AS sources
  FROM numbered_sources GROUP BY 1, 2),
rolled AS (SELECT claim_id, count(*) AS n_sources, bool_and(valid) AS ok FROM checked GROUP BY 1),
entries AS (
  SELECT c.page_id, row_number() OVER (PARTITION BY c.page_id ORDER BY c.position, c.claim_id, p.source_part) AS no,
         c.claim_id || '|' || c.position || '|' || CASE WHEN coalesce(ok, false) AND c.trust_state = 'verified' THEN 'verified|-'
           ELSE 'needs_review|source_not_current' END || '|' || coalesce(n_sources, 0) || '|' || coalesce(p.source_part, 0)
           || '|' || substr(sha256(c.text), 1, 16) || '|' || coalesce(p.sources, '') AS entry
  FROM claims c SEMI JOIN wiki_pages w ON w.page_id = c.page_id LEFT JOIN rolled USING (claim_id) LEFT JOIN source_parts p USING (claim_id)),
parts AS (
  SELECT page_id, (no - 1) // 20 AS part_no, count(*) AS n_entries, string_agg(entry, ';' ORDER BY no) AS model
  FROM entries GROUP BY 1, 2)""",
        select="""
SELECT page_id, slug, coalesce(part_no, 0) AS part_no, coalesce(n_entries, 0) AS n_entries, coalesce(model, '') AS model
FROM wiki_pages LEFT JOIN parts USING (page_id)""",
    ),
    "claims_admissible": S.sql(
        *CLAIM_PARTS,
        select="""
SELECT claim_id, page_id, position FROM claims
WHERE trust_state = 'verified' AND claim_id IN (SELECT claim_id FROM checked WHERE valid)""",
    ),
    "claims_invalidated": S.sql(
        *CLAIM_PARTS,
        """changed AS (
  SELECT DISTINCT s.claim_id FROM claim_sources s JOIN documents_dim d USING (doc_id)
  WHERE d.deleted OR d.active_version_id LIKE '%-v2'),
marked AS (SELECT *, trust_state = 'verified' AND claim_id IN (SELECT claim_id FROM changed) AS fall FROM claims)""",
        select="""
SELECT claim_id, CASE WHEN fall THEN 'needs_review' ELSE trust_state END AS trust_state,
       CASE WHEN fall THEN 'source_not_current' END AS reason
FROM marked""",
    ),
    "constraint_report": S.sql(
        S.BASES, S.DIM, S.CHUNKS, PAGES, CLAIMS,
        select="""
SELECT 'uq_documents_base_sha256' AS constraint_name, source || '|' || sha256(text) AS value, count(*) AS n
FROM documents GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT 'uq_chunks_version_ordinal_kind', version_id || '|' || ordinal || '|' || kind, count(*)
FROM chunks GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT 'uq_wiki_page_aliases', page_id || '|' || normal, count(*)
FROM (SELECT page_id, trim(regexp_replace(replace(lower(trim(alias)), 'ß', 'ss'), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS normal
      FROM alias_rows) GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT 'uq_pages_url', url, count(*) FROM pages GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT 'ck_claim_type', claim_type, count(*) FROM claims WHERE claim_type NOT IN ('topic_fact', 'manual') GROUP BY 1, 2
UNION ALL SELECT 'ck_role', role, count(*) FROM conversations WHERE role NOT IN ('user', 'assistant') GROUP BY 1, 2""",
    ),
    "eval_recall_mrr": S.sql(
        *PUBLIC_PARTS,
        """ranks AS (
  SELECT e.query_id, min(r.rank) AS rank FROM expected e LEFT JOIN results r USING (query_id, doc_id) GROUP BY 1)""",
        select="""
SELECT count(*) AS n_queries, round(avg(CASE WHEN rank <= 8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS recall,
       round(avg(coalesce(1.0::DOUBLE / rank, 0.0::DOUBLE)), 6) AS mrr,
       round(avg(CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS top1
FROM ranks""",
    ),
    "eval_no_answer": S.sql(
        *PUBLIC_PARTS,
        """judged AS (
  SELECT q.query_id, bool_or(coalesce(contains(lower(r.excerpt), lower(q.text)), false)) AS answered
  FROM queries q LEFT JOIN results r USING (query_id)
  WHERE q.query_id NOT IN (SELECT query_id FROM expected) GROUP BY 1)""",
        select="""
SELECT count(*) AS n_queries, round(avg(CASE WHEN answered THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS false_answer_rate FROM judged""",
    ),
    "eval_page_recall": S.sql(
        *PUBLIC_PARTS,
        select="""
SELECT e.query_id, round(count(r.doc_id) / count(*), 6) AS recall
FROM (SELECT DISTINCT * FROM expected) e LEFT JOIN (SELECT DISTINCT query_id, doc_id FROM results) r USING (query_id, doc_id)
GROUP BY 1""",
    ),
    "eval_term_recall": S.sql(
        *PUBLIC_PARTS,
        """words AS (SELECT DISTINCT query_id, term FROM query_terms WHERE length(term) >= 8),
hits AS (
  SELECT w.query_id, w.term, bool_or(coalesce(contains(lower(r.excerpt), w.term), false)) AS hit
  FROM words w LEFT JOIN results r USING (query_id) GROUP BY 1, 2)""",
        select="SELECT query_id, round(avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS recall FROM hits GROUP BY 1",
    ),
    "eval_citation_precision": S.sql(
        *PUBLIC_PARTS,
        """relevant AS (
  SELECT DISTINCT r.query_id, r.chunk_id, r.doc_id FROM results r JOIN query_terms t USING (query_id)
  WHERE length(t.term) >= 10 AND contains(lower(r.excerpt), t.term))""",
        select="""
SELECT count(*) AS n_citations, round(avg(CASE WHEN e.doc_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS precision
FROM relevant r LEFT JOIN (SELECT DISTINCT * FROM expected) e USING (query_id, doc_id)""",
    ),
    "eval_consistency": S.sql(
        *SOURCE_PARTS,
        """sets AS (
  SELECT a.case_id, a.query_id, coalesce(list(DISTINCT s.doc_id) FILTER (s.doc_id IS NOT NULL), []) AS docs
  FROM asked a LEFT JOIN sources s USING (query_id) GROUP BY 1, 2)""",
        select="""
SELECT l.case_id, round(avg(CASE WHEN len(l.docs) + len(r.docs) = 0 THEN 1.0::DOUBLE ELSE
         len(list_intersect(l.docs, r.docs)) / (len(l.docs) + len(r.docs) - len(list_intersect(l.docs, r.docs))) END), 6) AS consistency
FROM sets l JOIN sets r ON l.case_id = r.case_id AND l.query_id < r.query_id GROUP BY 1""",
    ),
    "eval_no_match": S.sql(
        *SEARCH_PARTS, EXPECTED,
        """unanswerable AS (SELECT query_id FROM asked WHERE case_id NOT IN (SELECT query_id FROM expected)),
violations AS (
  SELECT DISTINCT r.query_id, t.term FROM returned r JOIN claims c USING (claim_id) JOIN query_terms t ON t.query_id = r.query_id
  WHERE length(t.term) >= 12 AND contains(lower(c.text), t.term))""",
        select="""
SELECT count(*) AS n_queries,
       round(avg(CASE WHEN query_id IN (SELECT query_id FROM returned) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS false_match_rate,
       (SELECT count(*) FROM violations) AS forbidden_violations
FROM unanswerable""",
        recursive=True,
    ),
    "eval_leaks": S.sql(
        *SOURCE_PARTS, CLAIMS, CHECKED,
        "cited AS (SELECT DISTINCT c.claim_id FROM sources s JOIN claim_sources c USING (chunk_id))",
        select="""
SELECT count(*) AS n_claims, count(*) FILTER (c.trust_state <> 'verified') AS needs_review_leaks,
       (SELECT count(*) FROM checked WHERE NOT valid AND claim_id IN (SELECT claim_id FROM cited)) AS invalid_source_leaks
FROM cited JOIN claims c USING (claim_id)""",
    ),
}
