"""Claim-level wiki search: two page channels, claim scoring, diversity, budgets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import fusion, mmr
from corpusloom.operators.fuzzy import metadata_top_k
from corpusloom.operators.ordering import number_rows, top_k
from corpusloom.plans import wiki_budget
from corpusloom.plans.retrieve import query_status
from corpusloom.session import pinned

METADATA_ROWS = 200
METADATA_PAGES = 40
SOURCE_LIMIT = 40
PAGE_LIMIT = 5
CLAIM_LIMIT = 12
CLAIMS_PER_PAGE = 4
CHARACTER_BUDGET = 12_000
SOURCES_UNAVAILABLE = "source_retrieval_unavailable"
RERANKER_UNAVAILABLE = "reranker_unavailable"


def valid_queries(queries: DataFrame) -> DataFrame:
    """Queries that may run, with their normalised form as `query`."""
    checked = queries.withColumn("status", query_status(F.col("text"), F.lit(PAGE_LIMIT)))
    return checked.where("status = 'ok'").withColumn("query", T.normalize_query(F.col("text"))).drop("status")


def searchable_pages(pages: DataFrame) -> DataFrame:
    return pages.where((F.col("page_type") != "index") & F.col("enabled") & F.col("wiki_enabled"))


def metadata_channel(pages: DataFrame, queries: DataFrame) -> DataFrame:
    """Pages by title, summary, alias and slug: 200 by exact, slug, relevance; 40 of them by exact,
    relevance, id. The slug decides only about the first cut."""
    scored = metadata_top_k(searchable_pages(pages), queries, METADATA_ROWS)
    order = [F.desc("exact_match"), F.desc("relevance"), "page_id"]
    return top_k(scored, ["query_id"], order, METADATA_PAGES, into="position")


def provenance_channel(sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """Pages citing the found source chunks, by best source rank, then page id."""
    cited = sources.select("query_id", "chunk_id", F.col("rank").alias("source_rank")).join(
        evidence.select("chunk_id", "page_id"), "chunk_id"
    )
    best = cited.groupBy("query_id", "page_id").agg(F.min("source_rank").alias("source_rank"))
    place = Window.partitionBy("query_id").orderBy("source_rank", "page_id")
    return best.withColumn("position", F.row_number().over(place))


def fused_pages(metadata: DataFrame, provenance: DataFrame, pages: DataFrame) -> DataFrame:
    """Both channels fused; pages that are not searchable drop out, the order closes up."""
    channels = fusion.tagged_union(
        [c.select("query_id", F.col("page_id").alias("item_id"), "position") for c in (metadata, provenance)]
    )
    fused = fusion.reciprocal_rank_fusion(channels).withColumnRenamed("item_id", "page_id")
    kept = fused.join(searchable_pages(pages).select("page_id", "slug", "title"), "page_id")
    order = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("page_order", F.row_number().over(order)).drop("rank")


def page_claims(evidence: DataFrame) -> DataFrame:
    """One row per admissible claim, however many valid sources it has."""
    return evidence.groupBy("page_id", "claim_id").agg(
        F.first("text").alias("text"), F.first("position").alias("position")
    )


def score_claims(asked: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Score every claim of the asked pages: 1 / best matched source rank + lexical relevance.

    `asked` is (query_id, page_id, query). Ranks are matched on ids alone; the tokens of a query
    are taken once per query, those of a claim once per claim, and join the scored rows at the end.
    """
    words = asked.select("query_id", "query").distinct()
    words = words.select("query_id", T.query_token_set(F.col("query")).alias("query_tokens"))
    wanted = evidence.join(asked.select("page_id").distinct(), "page_id", "left_semi")
    facts = page_claims(wanted).select(
        "claim_id",
        "text",
        F.col("position").alias("claim_position"),
        T.query_token_set(F.col("text")).alias("text_tokens"),
        T.token_set(F.col("text")).alias("tokens"),
    )
    rows = asked.select("query_id", "page_id").join(wanted.select("page_id", "claim_id", "chunk_id"), "page_id")
    ranks = sources.select("query_id", "chunk_id", F.col("rank").alias("source_rank"))
    best = (
        rows.join(ranks, ["query_id", "chunk_id"], "left")
        .groupBy("query_id", "page_id", "claim_id")
        .agg(F.min("source_rank").alias("best_rank"))
    )
    lexical = T.overlap_share(F.col("query_tokens"), F.col("text_tokens"))
    return (
        best.join(facts, "claim_id")
        .join(words, "query_id")
        .withColumn("relevance", F.coalesce(1.0 / F.col("best_rank"), F.lit(0.0)) + lexical)
        .drop("query_tokens", "text_tokens")
    )


def claim_order_input(scored: DataFrame) -> DataFrame:
    """Columns the greedy order needs; `seq` is any number that sorts by position and claim id."""
    return scored.select(
        "query_id",
        "page_id",
        "claim_id",
        F.col("claim_position").alias("seq"),
        "relevance",
        F.length("text").alias("cost"),
        "tokens",
    )


def reranked_pages(
    ordered: DataFrame, asked: DataFrame, pages: DataFrame, evidence: DataFrame, reranker: Callable[[Column, Column], Column]
) -> DataFrame:
    """Pages of each query in the order of a reranker's score of (query, page passage), with `failed`.

    A null score is a failure: that query keeps its fused order. One page needs no order and cannot fail. Only the
    first claims of the pages in question are looked up.
    """
    wanted = evidence.join(ordered.select("page_id").distinct(), "page_id", "left_semi")
    first = wanted.groupBy("page_id").agg(F.min_by("text", F.struct("position", "claim_id")).alias("first_claim"))
    texts = pages.select("page_id", "aliases", "summary").join(first, "page_id", "left")
    rows = ordered.join(asked.select("query_id", "query"), "query_id").join(texts, "page_id")
    passage = T.page_passage(F.col("title"), F.col("aliases"), F.col("summary"), F.col("first_claim"))
    by_query = Window.partitionBy("query_id")
    scored = rows.withColumn("judged", reranker(F.col("query"), passage))
    alone = F.count(F.lit(1)).over(by_query) == 1
    failed = F.max(F.col("judged").isNull()).over(by_query) & ~alone
    marked = scored.withColumn("failed", failed)
    order = by_query.orderBy(F.desc_nulls_last(F.when(~F.col("failed"), F.col("judged"))), "page_order")
    return marked.withColumn("page_order", F.row_number().over(order)).select(*ordered.columns, "failed")


def budget_walk(walk: DataFrame, page_limit: int, claim_limit: int, budget: int) -> DataFrame:
    """(query_id, rows, told): each query's claims in page and pick order, and what the budgets say of them."""
    row = F.struct("page_order", "pick", "page_id", "claim_id", "relevance", "cost")
    grouped = walk.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    told = wiki_budget.admitted(F.col("rows"), page_limit, claim_limit, CLAIMS_PER_PAGE, budget)
    return grouped.withColumn("told", told)


def admitted_claims(walked: DataFrame) -> DataFrame:
    """Admitted claims of each query in page and pick order, with the truncation reason."""
    kept = walked.select(
        "query_id",
        F.col("told.reason").alias("truncation_reason"),
        F.explode(F.transform("told.kept", lambda i: F.element_at("rows", i))).alias("r"),
    )
    in_page = Window.partitionBy("query_id", "page_id").orderBy("pick")
    return kept.select(
        "query_id",
        F.col("r.page_order").cast("long").alias("page_order"),
        F.col("r.page_id").alias("page_id"),
        F.col("r.claim_id").alias("claim_id"),
        F.col("r.pick").alias("pick"),
        F.col("r.relevance").alias("claim_score"),
        "truncation_reason",
    ).withColumn("claim_rank", F.row_number().over(in_page).cast("long")).drop("pick")


def search_with_status(
    queries: DataFrame,
    pages: DataFrame,
    evidence: DataFrame,
    sources: DataFrame,
    *,
    page_limit: int = PAGE_LIMIT,
    claim_limit: int = CLAIM_LIMIT,
    character_budget: int = CHARACTER_BUDGET,
    reranker: Callable[[Column, Column], Column] | None = None,
    source_failures: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Matched claims per query, flat, and one status row per query.

    A claim row has page order and score, matched fields, claim rank and score, claims omitted on the page, the query's
    truncation reason, and whether and why its result is degraded. The status rows (query_id, n_pages, n_claims,
    truncation_reason, degraded, degradation_reason) name the queries without a match too.

    `sources` (query_id, chunk_id, rank) is the candidate search. `source_failures` (query_id, reason) names the
    queries whose search failed (`source_retrieval_unavailable`: their sources do not count) or went without its
    reranker (`source_reranker_unavailable`). `reranker` scores (query, page passage) and fails a query by a null; the
    first of these reasons is reported. Everything data-sized runs as joins; the fold over the budgets sees at most
    80 pages with a dozen picked claims each. `evidence` and `sources` are read by several steps and should be
    written tables.
    """
    if not 1 <= page_limit <= 20 or not 1 <= claim_limit <= 50:
        raise ValueError("invalid_search_options")
    if character_budget <= 0:
        raise ValueError("invalid_character_budget")
    if source_failures is not None:
        lost = source_failures.where(F.col("reason") == SOURCES_UNAVAILABLE)
        sources = sources.join(lost, "query_id", "left_anti")
    metadata = pinned(metadata_channel(pages, queries))
    provenance = pinned(provenance_channel(sources, evidence))
    ordered = pinned(fused_pages(metadata, provenance, pages))
    if reranker is None:
        ordered = ordered.withColumn("failed", F.lit(False))
    else:
        ordered = pinned(reranked_pages(ordered, queries, pages, evidence, reranker))
    asked = ordered.join(queries.select("query_id", "query"), "query_id")
    scored = claim_order_input(score_claims(asked, evidence, sources))
    n_pages = ordered.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_pages"))
    limit = F.when(F.col("n_pages") == 1, claim_limit).otherwise(CLAIMS_PER_PAGE)
    competing = pinned(scored.join(n_pages, "query_id").withColumn("picks", limit).drop("n_pages"))
    picked = mmr.first_picks(competing, "picks").join(
        competing.select("query_id", "claim_id", "page_id", "cost"), ["query_id", "page_id", "claim_id"]
    )
    walk = ordered.select("query_id", "page_id", "page_order").join(picked, ["query_id", "page_id"], "left")
    walked = pinned(budget_walk(walk, page_limit, claim_limit, character_budget))
    kept = admitted_claims(walked)
    totals = competing.groupBy("query_id", "page_id").agg(F.count(F.lit(1)).alias("n_claims"))
    shown = kept.groupBy("query_id", "page_id").agg(F.count(F.lit(1)).alias("n_shown"))
    omitted = shown.join(totals, ["query_id", "page_id"]).select(
        "query_id", "page_id", (F.col("n_claims") - F.col("n_shown")).alias("omitted_claim_count")
    )
    by_metadata = metadata.select("query_id", "page_id", "matched_fields")
    by_source = provenance.select("query_id", "page_id", F.array(F.lit("source_chunk")).alias("by_source"))
    none = F.array().cast("array<string>")
    fields = F.concat(F.coalesce("matched_fields", none), F.coalesce("by_source", none))
    reasons = query_reasons(queries, ordered, source_failures)
    found = (
        kept.join(omitted, ["query_id", "page_id"])
        .join(ordered.select("query_id", "page_id", "slug", "title", "score"), ["query_id", "page_id"])
        .join(by_metadata, ["query_id", "page_id"], "left")
        .join(by_source, ["query_id", "page_id"], "left")
        .join(reasons, "query_id")
        .withColumn("matched_fields", fields)
        .drop("by_source")
    )
    counts = kept.groupBy("query_id").agg(F.count_distinct("page_id").alias("n_pages"), F.count(F.lit(1)).alias("n_claims"))
    zero = F.lit(0).cast("long")
    status = (
        reasons.join(counts, "query_id", "left")
        .join(walked.select("query_id", F.col("told.reason").alias("truncation_reason")), "query_id", "left")
        .withColumns({"n_pages": F.coalesce("n_pages", zero), "n_claims": F.coalesce("n_claims", zero)})
    )
    return found, status


def query_reasons(queries: DataFrame, ordered: DataFrame, source_failures: DataFrame | None) -> DataFrame:
    """(query_id, degraded, degradation_reason) of every query: the source channel's reason, else the page reranker's."""
    failed = ordered.where("failed").select("query_id", F.lit(RERANKER_UNAVAILABLE).alias("page_reason")).distinct()
    rows = queries.select("query_id").join(failed, "query_id", "left")
    reason = F.col("page_reason")
    if source_failures is not None:
        rows = rows.join(source_failures.select("query_id", F.col("reason").alias("source_reason")), "query_id", "left")
        reason = F.coalesce("source_reason", "page_reason")
    return rows.select("query_id", reason.isNotNull().alias("degraded"), reason.alias("degradation_reason"))


def search(queries: DataFrame, pages: DataFrame, evidence: DataFrame, sources: DataFrame, **options) -> DataFrame:
    """The matched claims of `search_with_status`."""
    return search_with_status(queries, pages, evidence, sources, **options)[0]


def claim_sources(found: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, page_id, claim_id, source_no, chunk_id, doc_id): the valid sources of matched claims, flat.

    Sources are numbered once per claim, over blocks, so a claim that very many chunks support is neither ranked nor
    gathered in one task, and queries only join the numbers.
    """
    asked = found.select("page_id", "claim_id").distinct()
    cited = evidence.select("page_id", "claim_id", "chunk_id", "doc_id").distinct().join(asked, ["page_id", "claim_id"], "left_semi")
    numbered = number_rows(cited, ["page_id", "claim_id"], ["doc_id", "chunk_id"], into="source_no")
    return found.select("query_id", "page_id", "claim_id").join(numbered, ["page_id", "claim_id"]).select(
        "query_id", "page_id", "claim_id", "source_no", "chunk_id", "doc_id"
    )


def read_pages(requests: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims of requested pages: by position, or by relevance when the request has a query.

    `requests` is (request_id, page_id, query, cursor, limit); limits are 1..50. Adds the next
    cursor (null at the end) and how many claims lie behind the slice.
    """
    bounds = F.col("cursor") + F.col("limit")
    usable = requests.where((F.col("cursor") >= 0) & F.col("limit").between(1, 50)).withColumn("picks", bounds)
    facts = page_claims(evidence)
    totals = facts.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_claims"))
    plain = usable.where(T.strip(F.col("query")) == "")
    deepest = plain.agg(F.max("picks")).first()[0] or 1
    by_position = top_k(
        plain.join(facts, "page_id"), ["request_id"], ["position", "claim_id"], deepest, into="pick"
    ).select("request_id", "page_id", "claim_id", "text", "pick")
    asked = usable.where(T.strip(F.col("query")) != "").withColumn("query", T.normalize_query(F.col("query")))
    lexical = T.overlap_share(T.query_token_set(F.col("query")), T.query_token_set(F.col("text")))
    competing = pinned(
        asked.join(facts, "page_id").select(
            F.col("request_id").alias("query_id"),
            "page_id",
            "claim_id",
            F.col("position").alias("seq"),
            lexical.alias("relevance"),
            T.token_set(F.col("text")).alias("tokens"),
            "text",
            F.col("picks").cast("int").alias("picks"),
        )
    )
    by_relevance = mmr.first_picks(competing, "picks").join(
        competing.select("query_id", "page_id", "claim_id", "text"), ["query_id", "page_id", "claim_id"]
    )
    ranked = by_position.unionByName(
        by_relevance.select(F.col("query_id").alias("request_id"), "page_id", "claim_id", "text", "pick")
    )
    sliced = ranked.join(usable.select("request_id", "cursor", "limit"), "request_id").where(
        (F.col("pick") > F.col("cursor")) & (F.col("pick") <= F.col("cursor") + F.col("limit"))
    )
    behind = F.greatest(F.lit(0), F.col("n_claims") - F.col("cursor") - F.col("limit"))
    return sliced.join(totals, "page_id").select(
        "request_id",
        "page_id",
        "claim_id",
        "text",
        F.col("pick").cast("long").alias("place"),
        F.when(behind > 0, F.col("cursor") + F.col("limit")).cast("long").alias("next_cursor"),
        behind.cast("long").alias("omitted_claim_count"),
    )
