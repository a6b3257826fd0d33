"""Registered queries of the operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import (
    centroids,
    decontamination,
    language_id,
    line_dedup,
    merkle,
    ngram_join,
    pii,
    quality_rules,
    sentencepiece_codec,
    span_dedup,
    statements,
    substring_dedup,
    toxicity,
    url_filters,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_report(_table(spark, folder, "documents"))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_texts(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op3_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.jaccard_classes(_table(spark, folder, "documents"))


def op4_span_dedup(spark: SparkSession, folder: str) -> DataFrame:
    removed = span_dedup.remove_repeated_spans(_table(spark, folder, "documents"))
    return removed.select("doc_id", "n_sentences", "n_removed", "kept_sha256")


def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_codec.digests(_table(spark, folder, "documents"))


def op6_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_filters.judge(_table(spark, folder, "pages"))


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op8_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    removed = substring_dedup.remove_repeats(_table(spark, folder, "documents"))
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(_table(spark, folder, "documents"))


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(_table(spark, folder, "documents"))


def op11_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster_vectors(_table(spark, folder, "embeddings")).drop("n_checked")


def op12_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(_table(spark, folder, "documents"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(_table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_toxicity,
        op3_ngram_join,
        op4_span_dedup,
        op5_sentencepiece,
        op6_url_filters,
        op7_decontamination,
        op8_suffix_array_dedup,
        op9_quality_rules,
        op10_pii,
        op11_centroid_clustering,
        op12_language_id,
        op13_merkle_manifest,
    )
}
SQL: dict[str, str] = {
    "op11_centroid_clustering": statements.clusters_sql(),
    "op13_merkle_manifest": statements.merkle_sql(),
}
