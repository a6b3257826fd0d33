"""Retrieval quality: recall, reciprocal rank, citations, consistency, leaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-row results as one row."""
    both = left.unionByName(right, allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in both.columns))


def best_ranks(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, rank): best rank of an expected document, null when none was found."""
    hits = expected.join(results.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    return hits.groupBy("query_id").agg(F.min("rank").alias("rank"))


def recall_and_mrr(ranks: DataFrame, k: int = 8) -> DataFrame:
    """One row: answerable queries, Recall@k, MRR and share of queries right at rank 1."""
    rank = F.col("rank")
    return ranks.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.round(F.avg(F.when(rank <= k, 1.0).otherwise(0.0)), 6).alias("recall"),
        F.round(F.avg(F.coalesce(1.0 / rank, F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg(F.when(rank == 1, 1.0).otherwise(0.0)), 6).alias("top1"),
    )


def false_answers(queries: DataFrame, excerpts: DataFrame) -> DataFrame:
    """One row: unanswerable queries and the share whose text occurs in a returned excerpt."""
    joined = queries.join(excerpts.select("query_id", "excerpt"), "query_id", "left")
    hit = F.contains(F.lower("excerpt"), F.lower("text"))
    per_query = joined.groupBy("query_id").agg(F.max(F.coalesce(hit, F.lit(False))).alias("answered"))
    return per_query.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.round(F.avg(F.col("answered").cast("double")), 6).alias("false_answer_rate"),
    )


def page_recall(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, recall): share of the expected documents among the results."""
    found = results.select("query_id", "doc_id").distinct().withColumn("found", F.lit(1))
    return (
        expected.distinct()
        .join(found, ["query_id", "doc_id"], "left")
        .groupBy("query_id")
        .agg(F.round(F.count("found") / F.count(F.lit(1)), 6).alias("recall"))
    )


def term_recall(rendered: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, recall): share of expected terms that occur in any returned claim.

    `rendered` is (query_id, text) with one row per returned claim; `terms` is (query_id, term).
    """
    hit = F.contains(F.lower("text"), F.lower("term"))
    per_term = (
        terms.distinct()
        .join(rendered, "query_id", "left")
        .groupBy("query_id", "term")
        .agg(F.max(F.coalesce(hit, F.lit(False))).alias("hit"))
    )
    return per_term.groupBy("query_id").agg(F.round(F.avg(F.col("hit").cast("double")), 6).alias("recall"))


def citation_precision(citations: DataFrame, terms: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: citations of claims holding an expected term, and the share that cites an expected
    document.

    `citations` is (query_id, claim_id, text, doc_id), one row per returned source.
    """
    holds = F.contains(F.lower("text"), F.lower("term"))
    relevant = (
        citations.join(terms.distinct(), "query_id")
        .where(holds)
        .select("query_id", "claim_id", "doc_id")
        .distinct()
    )
    right = expected.distinct().withColumn("right", F.lit(True))
    judged = relevant.join(right, ["query_id", "doc_id"], "left")
    return judged.agg(
        F.count(F.lit(1)).alias("n_citations"),
        F.round(F.avg(F.col("right").isNotNull().cast("double")), 6).alias("precision"),
    )


def paraphrase_consistency(results: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, consistency): mean Jaccard of the result sets over the pairs of a case's queries.

    Queries with the same result set are counted together, so only distinct sets of a case are
    compared, each pair weighted by how many query pairs it stands for.
    """
    none = F.array().cast("array<long>")
    found = results.groupBy("query_id").agg(F.array_sort(F.collect_set("doc_id")).alias("docs"))
    sets = (
        cases.join(found, "query_id", "left")
        .groupBy("case_id", F.coalesce("docs", none).alias("docs"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("mark", F.xxhash64("docs"))
    )
    left = sets.select("case_id", F.col("docs").alias("d1"), F.col("n").alias("n1"), F.col("mark").alias("m1"))
    right = sets.select("case_id", F.col("docs").alias("d2"), F.col("n").alias("n2"), F.col("mark").alias("m2"))
    later = (F.col("m1") < F.col("m2")) | ((F.col("m1") == F.col("m2")) & (F.col("d1") < F.col("d2")))
    shared = F.size(F.array_intersect("d1", "d2"))
    score = shared / F.greatest(F.size(F.array_union("d1", "d2")), F.lit(1))
    weight = F.col("n1") * F.col("n2")
    apart = left.join(right, "case_id").where(later).select("case_id", weight.alias("w"), (score * weight).alias("s"))
    alike = F.col("n") * (F.col("n") - 1) / 2
    same = sets.where("n > 1").select("case_id", alike.cast("long").alias("w"), alike.alias("s"))
    pairs = apart.unionByName(same)
    return pairs.groupBy("case_id").agg(F.round(F.sum("s") / F.sum("w"), 6).alias("consistency"))


def false_matches(queries: DataFrame, results: DataFrame, texts: DataFrame, forbidden: DataFrame) -> DataFrame:
    """One row: share of unanswerable queries with any result, and forbidden terms in claims.

    `queries` is (query_id) of the unanswerable ones, `texts` is (query_id, text) of returned
    claims, `forbidden` is (query_id, term).
    """
    any_result = results.select("query_id").distinct().withColumn("matched", F.lit(True))
    rate = queries.join(any_result, "query_id", "left").agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.round(F.avg(F.col("matched").isNotNull().cast("double")), 6).alias("false_match_rate"),
    )
    hits = texts.join(forbidden, "query_id").where(F.contains(F.lower("text"), F.lower("term")))
    violations = hits.select("query_id", "term").distinct().agg(F.count(F.lit(1)).alias("forbidden_violations"))
    return _side_by_side(rate, violations)


def leak_counts(returned: DataFrame, claims: DataFrame, checked_sources: DataFrame) -> DataFrame:
    """One row: returned claims, those not verified, and their sources that are not current."""
    ids = returned.select("claim_id").distinct()
    states = ids.join(claims.select("claim_id", "trust_state"), "claim_id", "left")
    review = states.agg(
        F.count(F.lit(1)).alias("n_claims"),
        F.count_if(F.coalesce(F.col("trust_state") != "verified", F.lit(True))).alias("needs_review_leaks"),
    )
    invalid = checked_sources.join(ids, "claim_id", "left_semi").agg(
        F.count_if(~F.col("valid")).alias("invalid_source_leaks")
    )
    return _side_by_side(review, invalid)
