"""Wiki entities derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.ordering import top_k
from corpusloom.sources import tables


@tables.plan_once
def page_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as wiki pages: title, slug, first paragraph as summary, heading and anchors as names."""
    html = F.col("html")
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]+(/[^?#]*)?", 1)
    paragraph = F.regexp_extract(html, r"(?is)<p>(.*?)</?p>", 1)
    anchors = F.regexp_extract_all(html, F.lit(r"(?is)<a [^>]*>(.*?)</a>"), F.lit(1))
    heading = F.regexp_extract_all(html, F.lit(r"(?is)<h1>(.*?)</h1>"), F.lit(1))
    return tables.read(spark, folder, "pages", spread=True).select(
        F.col("page_id").alias("doc_id"),
        F.col("page_id").cast("string").alias("page_id"),
        F.concat(F.lit("p"), F.col("page_id").cast("string"), path).alias("slug"),
        F.lit("summary").alias("page_type"),
        F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1).alias("title"),
        T.strip(F.regexp_replace(paragraph, r"<[^>]*>", " ")).alias("summary"),
        F.concat(heading, anchors).alias("names"),
    )


@tables.plan_once
def alias_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, title, alias, position): the raw names of every page in order."""
    return page_fields(spark, folder).select(
        "page_id", "title", F.posexplode("names").alias("position", "alias")
    )


@tables.plan_once
def wiki_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Published pages of the documents with the same number, their base and its flags."""
    from corpusloom.plans.wiki_build import page_aliases

    fields = page_fields(spark, folder).drop("names")
    aliases = page_aliases(alias_rows(spark, folder))
    per_page = aliases.groupBy("page_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "alias"))), lambda x: x["alias"]
        ).alias("aliases")
    )
    docs = tables.documents_dim(spark, folder).select("doc_id", "kb_id")
    bases = tables.knowledge_bases(spark, folder)
    return (
        fields.join(docs, "doc_id")
        .join(bases, "kb_id")
        .join(per_page, "page_id", "left")
        .withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    )


def claims_of(spark: SparkSession, folder: str, chunks: DataFrame) -> DataFrame:
    """One claim per section of a document's first version, with its stored trust state.

    `chunks` are those of `tables.chunks`, cut anew or as the search index holds them.
    """
    quality = tables.read(spark, folder, "labels").select("doc_id", "quality")
    parents = chunks.where("version_no = 1 AND kind = 'parent'")
    claim = F.concat_ws("-", F.lit("c"), F.col("doc_id").cast("string"), F.col("section_no").cast("string"))
    facts = parents.select(
        claim.alias("claim_id"),
        "doc_id",
        F.col("doc_id").cast("string").alias("page_id"),
        "kb_id",
        F.col("section_no").alias("position"),
        T.first_sentence(F.col("content")).alias("text"),
    )
    return facts.join(quality, "doc_id", "left").select(
        *facts.columns,
        F.when(F.coalesce(F.col("quality"), F.lit(1)) == 1, "verified").otherwise("needs_review").alias("trust_state"),
        F.lit("summary_fact").alias("claim_type"),
    )


@tables.plan_once
def claims(spark: SparkSession, folder: str) -> DataFrame:
    return claims_of(spark, folder, tables.chunks(spark, folder))


def claim_sources_of(chunks: DataFrame) -> DataFrame:
    """Locator snapshots: the children of a claim's section; some digests have drifted."""
    children = chunks.where("version_no = 1 AND kind = 'child'")
    drifted = (F.col("doc_id") % 7 == 0) & (F.col("child_no") > 1)
    claim = F.concat_ws("-", F.lit("c"), F.col("doc_id").cast("string"), F.col("section_no").cast("string"))
    return children.select(
        claim.alias("claim_id"),
        "doc_id",
        "version_id",
        "chunk_id",
        F.col("kind").alias("chunk_kind"),
        F.col("ordinal").alias("chunk_ordinal"),
        T.sha256_hex(F.when(drifted, F.concat(F.lit("stale:"), "content")).otherwise(F.col("content"))).alias(
            "content_sha256"
        ),
    )


@tables.plan_once
def claim_sources(spark: SparkSession, folder: str) -> DataFrame:
    return claim_sources_of(tables.chunks(spark, folder))


@tables.plan_once
def active_children(spark: SparkSession, folder: str) -> DataFrame:
    """Children of active versions with their 1-based number inside the version."""
    active = tables.documents_dim(spark, folder).where(
        "active_version_id IS NOT NULL AND NOT deleted"
    ).select(F.col("active_version_id").alias("version_id"))
    return (
        tables.children(spark, folder)
        .join(active, "version_id", "left_semi")
        .withColumn("child_index", F.col("ordinal") - F.col("section_no"))
    )


@tables.plan_once
def long_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(kb_id, doc_id, version_id, chunk_id, child_index, token): tokens of six letters or more."""
    words = F.regexp_extract_all(T.fold(F.col("content")), F.lit("[a-z0-9]{6,}"), F.lit(0))
    return active_children(spark, folder).select(
        "kb_id", "doc_id", "version_id", "chunk_id", "child_index", F.explode(words).alias("token")
    )


def _first_topics(spark: SparkSession, folder: str, *more: Column) -> DataFrame:
    """Five most frequent long tokens of each document, with `more` aggregates of their mentions.

    A document has one active version, by which its tokens lie together already: with the version in every key, neither
    counting nor ranking shuffles them again.
    """
    document = ["kb_id", "doc_id", "version_id"]
    counted = long_tokens(spark, folder).groupBy(*document, F.col("token").alias("name")).agg(F.count(F.lit(1)).alias("n"), *more)
    return top_k(counted, document, [F.desc("n"), "name"], 5)


@tables.plan_once
def topics(spark: SparkSession, folder: str) -> DataFrame:
    """Five most frequent long tokens of each document as its topics, in rank order."""
    return _first_topics(spark, folder).select("kb_id", "doc_id", "name", "rank")


@tables.plan_once
def topic_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """(kb_id, doc_id, name, rank, chunk_ids): the topics, each with the children of its document that mention it."""
    chunk_ids = F.collect_set("chunk_id").alias("chunk_ids")
    return _first_topics(spark, folder, chunk_ids).select("kb_id", "doc_id", "name", "rank", "chunk_ids")


def topic_sources_of(mentions: DataFrame) -> DataFrame:
    """(kb_id, doc_id, name, chunk_id): the children that mention a document's topic."""
    return mentions.select("kb_id", "doc_id", "name", F.explode("chunk_ids").alias("chunk_id"))


@tables.plan_once
def case_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Query vectors of the wiki queries: all sentences of a passage share its vector."""
    vectors = tables.query_vectors(spark, folder).withColumnRenamed("query_id", "case_id")
    return tables.query_sentences(spark, folder).select("query_id", "case_id").join(vectors, "case_id").drop("case_id")
