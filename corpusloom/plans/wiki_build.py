"""Wiki derivation: grounded claims, topics, rendered pages, index, links.

Long pages are kept as numbered lines, not as one string: a topic or index page of a hot base may
list a third of the corpus and must not be gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.components import connected_components
from corpusloom.operators.ordering import number_rows, top_k

BATCH = 12
CLAIM_CHARACTERS = 2000
TOPIC_CHARACTERS = 80
TOPICS_KEPT = 5
INPUT_CHARACTERS = 1600
TOKENS_PER_CALL = 1500

# The wording of rendered pages.
SUMMARY_HEADING = "## 摘要"
SOURCES_HEADING = "## 来源"
SOURCE_LABEL = "原文分块"
TOPIC_INTRO = "来自多篇文档的相关内容："
SEE_ALSO = "参见"
TOPIC_SUMMARY = "篇文档涉及"
INDEX_TITLE = "# Wiki 目录"
INDEX_TOPICS = "## 主题"
INDEX_SUMMARIES = "## 文档摘要"


def batch_number(child_index: Column) -> Column:
    """Batch of a 1-based child number: twelve consecutive children per generation call."""
    return F.floor((child_index - 1) / BATCH)


def lead_sentence_claims(children: DataFrame) -> DataFrame:
    """The default generator: the first sentence of every child as a claim citing that child.

    Returns drafts (doc_id, version_id, batch, position, text, source_indices).
    """
    return children.select(
        "doc_id",
        "version_id",
        batch_number(F.col("child_index")).alias("batch"),
        F.col("child_index").alias("position"),
        F.substring(T.strip(T.first_sentence(F.col("content"))), 1, CLAIM_CHARACTERS).alias("text"),
        F.array(F.col("child_index")).alias("source_indices"),
    )


def _ordered(values: Column) -> Column:
    """Flatten (position, array) pairs in position order, repeats removed, first kept."""
    return F.array_distinct(F.flatten(F.transform(F.array_sort(values), lambda x: x["value"])))


def merge_claims(drafts: DataFrame) -> DataFrame:
    """Merge drafts of a document by merge key: first text, all sources in order. Drafts may bring their `merge_key`.

    The collected arrays belong to one document, so they are bounded by its own children.
    """
    keyed = drafts if "merge_key" in drafts.columns else drafts.withColumn("merge_key", T.merge_key(F.col("text")))
    return keyed.groupBy("doc_id", "version_id", "merge_key").agg(
        F.min_by("text", "position").alias("text"),
        F.min("position").alias("position"),
        _ordered(F.collect_list(F.struct("position", F.col("source_indices").alias("value")))).alias(
            "source_indices"
        ),
    )


def numbered_claims(merged: DataFrame) -> DataFrame:
    """Merged claims with `claim_no` in the order of their first draft; a version's claims are bounded by its text."""
    place = Window.partitionBy("doc_id", "version_id").orderBy("position")
    return merged.withColumn("claim_no", F.row_number().over(place))


def merge_topics(partials: DataFrame, keep: int = TOPICS_KEPT) -> DataFrame:
    """Merge topic drafts (doc_id, version_id, position, name, aliases, source_indices) by key.

    Aliases are united without the own name; the first five topics of a document stay. Drafts may bring their `merge_key`.
    """
    keyed = partials if "merge_key" in partials.columns else partials.withColumn("merge_key", T.merge_key(F.col("name")))
    merged = keyed.groupBy("doc_id", "version_id", "merge_key").agg(
        F.min_by("name", "position").alias("name"),
        F.min("position").alias("position"),
        _ordered(F.collect_list(F.struct("position", F.col("aliases").alias("value")))).alias("aliases"),
        _ordered(F.collect_list(F.struct("position", F.col("source_indices").alias("value")))).alias(
            "source_indices"
        ),
    )
    cleaned = merged.withColumn("aliases", F.array_remove("aliases", F.col("name")))
    return top_k(cleaned, ["doc_id"], ["position"], keep, into="topic_no")


def bind_sources(claims: DataFrame, children: DataFrame) -> DataFrame:
    """Locator rows of claims: every cited index resolved to the child of the same version.

    `claims` is (doc_id, version_id, claim_no, source_indices); indices are 1-based.
    """
    cited = claims.select(
        "doc_id", "version_id", "claim_no", F.posexplode(F.array_distinct("source_indices")).alias("source_no", "child_index")
    )
    located = children.select(
        "version_id",
        "child_index",
        "chunk_id",
        "kind",
        "ordinal",
        "heading_path",
        T.sha256_hex(F.col("content")).alias("content_sha256"),
    )
    return cited.join(located, ["version_id", "child_index"])


def strict_total(value: Column) -> Column:
    """Sum that is null as soon as one part is null."""
    return F.when(F.count_if(value.isNull()) == 0, F.sum(value))


def generation_calls(chunks: Column) -> Column:
    """Model calls for n chunks: one per twelve, then one per twelve partial results, and so on."""
    total = F.ceil(chunks / BATCH)
    size = BATCH
    for _ in range(15):
        above = F.ceil(chunks / size)
        size *= BATCH
        total = total + F.when(above > 1, F.ceil(chunks / size)).otherwise(0)
    return total


def generation_cost(children: DataFrame) -> DataFrame:
    """(doc_id, version_id, n_chunks, calls, estimate): reserved tokens of a generation."""
    sized = children.groupBy("doc_id", "version_id").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.sum(F.least(F.length("content"), F.lit(INPUT_CHARACTERS))).alias("input"),
    )
    calls = generation_calls(F.col("n_chunks"))
    return sized.select(
        "doc_id",
        "version_id",
        "n_chunks",
        calls.cast("long").alias("calls"),
        (F.col("input") + TOKENS_PER_CALL * calls).cast("long").alias("estimate"),
    )


def render_summaries(claims: DataFrame, bound: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, content): claims as bullets with footnote marks, then the source locators.

    One page holds the claims of one document, so its text is bounded by the document.
    """
    number = F.col("claim_no").cast("string")
    mark = F.concat(F.lit("claim-"), number, F.lit("-source-"), (F.col("source_no") + 1).cast("string"))
    trail = F.array_join("heading_path", " / ")
    place = F.concat(F.lit(SOURCE_LABEL + " "), (F.col("ordinal") + 1).cast("string"))
    place = F.when(trail != "", F.concat(place, F.lit("（"), trail, F.lit("）"))).otherwise(place)
    per_claim = bound.groupBy("doc_id", "claim_no").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "source_no",
                    F.concat(F.lit("[^"), mark, F.lit("]")).alias("mark"),
                    F.concat(F.lit("[^"), mark, F.lit("]: "), place).alias("note"),
                )
            )
        ).alias("notes")
    )
    lines = claims.join(per_claim, ["doc_id", "claim_no"]).select(
        "doc_id",
        "claim_no",
        F.concat(
            F.lit("- "), "text", F.lit(" "), F.array_join(F.transform("notes", lambda n: n["mark"]), " ")
        ).alias("line"),
        F.transform("notes", lambda n: n["note"]).alias("notes"),
    )
    pages = lines.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("claim_no", "line", "notes"))).alias("rows")
    )
    head = F.array(F.concat(F.lit("# "), F.col("title")), F.lit(""), F.lit(SUMMARY_HEADING))
    body = F.concat(
        head,
        F.transform("rows", lambda r: r["line"]),
        F.array(F.lit(""), F.lit(SOURCES_HEADING), F.lit("")),
        F.flatten(F.transform("rows", lambda r: r["notes"])),
    )
    return pages.join(titles.select("doc_id", "title"), "doc_id").select(
        "doc_id", "title", F.array_join(body, "\n").alias("content")
    )


def page_aliases(raw: DataFrame) -> DataFrame:
    """Alias set of pages: no empty ones, none equal to the title, the first of each normal form.

    `raw` is (page_id, title, alias, position).
    """
    keyed = raw.withColumns(
        {
            "normalized_alias": T.normalize_alias(F.col("alias")),
            "_title": T.normalize_alias(F.col("title")),
        }
    ).where("normalized_alias <> '' AND normalized_alias <> _title")
    first = keyed.groupBy("page_id", "normalized_alias").agg(F.min(F.struct("position", "alias")).alias("a"))
    return first.select(
        "page_id",
        T.strip(F.col("a.alias")).alias("alias"),
        "normalized_alias",
        F.col("a.position").alias("position"),
    )


def topic_identities(topics: DataFrame) -> DataFrame:
    """(kb_id, name, topic_key): names that share a normalised name or alias are one topic.

    `topics` is (kb_id, name, aliases). Identity is the connected component of the graph between
    names and aliases, so it does not depend on row order; the key is the component's least form.
    """
    named = topics.select("kb_id", "name", "aliases").distinct()
    own = T.normalize_alias(F.col("name"))
    links = named.select("kb_id", own.alias("own"), F.explode(F.concat(F.array("name"), "aliases")).alias("other"))
    links = links.select("kb_id", "own", T.normalize_alias(F.col("other")).alias("other")).where(
        "own <> '' AND other <> ''"
    )
    edges = links.select(F.struct("kb_id", F.col("own").alias("form")).alias("u"), F.struct("kb_id", F.col("other").alias("form")).alias("v"))
    labels = connected_components(edges.distinct())
    return (
        named.select("kb_id", "name", own.alias("form"))
        .distinct()
        .join(
            labels.select(
                F.col("node.kb_id").alias("kb_id"),
                F.col("node.form").alias("form"),
                F.col("component.form").alias("topic_key"),
            ),
            ["kb_id", "form"],
        )
        .select("kb_id", "name", "topic_key")
    )


def topic_slug(key: Column) -> Column:
    return F.concat(F.lit("topic/"), T.short_digest(key))


def topic_evidence(
    topics: DataFrame, identities: DataFrame, topic_sources: DataFrame, claims: DataFrame, claim_sources: DataFrame
) -> DataFrame:
    """Claims of each cross-document topic (kb_id, topic_key, doc_id, claim_id, text, position).

    A topic needs at least two documents. A document's verified claims count when one of their
    sources is a chunk of the document's own mention of the topic. Topic chunks and claim sources
    meet on the chunk id, so a topic with very many documents is spread by chunk.
    """
    keyed = topics.select("kb_id", "doc_id", "name").join(identities, ["kb_id", "name"])
    support = keyed.groupBy("kb_id", "topic_key").agg(F.count_distinct("doc_id").alias("n_documents"))
    wide = support.where("n_documents >= 2")
    mentions = (
        topic_sources.join(identities, ["kb_id", "name"])
        .select("kb_id", "topic_key", "doc_id", "chunk_id")
        .distinct()
        .join(wide.select("kb_id", "topic_key"), ["kb_id", "topic_key"], "left_semi")
    )
    cited = claim_sources.select("claim_id", "chunk_id")
    pairs = mentions.join(cited, "chunk_id").select("kb_id", "topic_key", "doc_id", "claim_id").distinct()
    verified = claims.where("trust_state = 'verified'").select("claim_id", "doc_id", "text", "position")
    return pairs.join(verified, ["claim_id", "doc_id"])


def topic_pages(topics: DataFrame, identities: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per topic page: slug, title, number of documents and claims, summary."""
    keyed = topics.join(identities, ["kb_id", "name"])
    heads = keyed.groupBy("kb_id", "topic_key").agg(
        F.min_by("name", F.struct("doc_id", "rank")).alias("title"),
        F.count_distinct("doc_id").alias("n_documents"),
    )
    used = evidence.groupBy("kb_id", "topic_key").agg(F.count(F.lit(1)).alias("n_claims"))
    pages = heads.join(used, ["kb_id", "topic_key"])
    title = F.substring("title", 1, TOPIC_CHARACTERS)
    return pages.select(
        "kb_id",
        "topic_key",
        topic_slug(F.col("topic_key")).alias("slug"),
        title.alias("title"),
        "n_documents",
        "n_claims",
        F.concat_ws(" ", F.col("n_documents").cast("string"), F.lit(TOPIC_SUMMARY), title).alias("summary"),
    )


def topic_page_lines(pages: DataFrame, evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """Topic pages as numbered lines (kb_id, slug, line_no, line)."""
    named = documents.select(
        "doc_id",
        F.col("title").alias("doc_title"),
        F.concat(F.lit("summary/"), F.col("doc_id").cast("string")).alias("doc_slug"),
    )
    claims = evidence.select("kb_id", "topic_key", "doc_id", "position", "claim_id", "text")
    sections = claims.select("kb_id", "topic_key", "doc_id").distinct().join(named, "doc_id")

    def entry(part: int, line: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), line.alias("line"))

    head = pages.select(
        "kb_id",
        "topic_key",
        F.lit(-1).cast("long").alias("doc_id"),
        F.inline(
            F.array(
                entry(0, F.concat(F.lit("# "), F.col("title"))), entry(1, F.lit("")), entry(2, F.lit(TOPIC_INTRO))
            )
        ),
    ).withColumns({"position": F.lit(0), "claim_id": F.lit("")})
    frame = sections.select(
        "kb_id",
        "topic_key",
        "doc_id",
        F.inline(
            F.array(
                entry(0, F.lit("")),
                entry(1, F.concat(F.lit("## "), F.col("doc_title"))),
                entry(2, F.lit("")),
                entry(4, F.lit("")),
                entry(5, F.concat(F.lit(SEE_ALSO + " [["), "doc_slug", F.lit("|"), "doc_title", F.lit("]]"))),
            )
        ),
    ).withColumns({"position": F.lit(0), "claim_id": F.lit("")})
    bullets = claims.select(
        "kb_id",
        "topic_key",
        "doc_id",
        F.lit(3).alias("part"),
        F.concat(F.lit("- "), F.col("text")).alias("line"),
        "position",
        "claim_id",
    )
    rows = head.unionByName(frame).unionByName(bullets)
    numbered = number_rows(
        rows, ["kb_id", "topic_key"], ["doc_id", "part", "position", "claim_id"], into="line_no"
    )
    return numbered.select("kb_id", topic_slug(F.col("topic_key")).alias("slug"), "line_no", "line")


def topic_claims(evidence: DataFrame) -> DataFrame:
    """Claims copied to topic pages, positions from 0 in document and claim order."""
    numbered = number_rows(evidence, ["kb_id", "topic_key"], ["doc_id", "position", "claim_id"])
    return numbered.select(
        "kb_id",
        topic_slug(F.col("topic_key")).alias("slug"),
        F.concat_ws(":", F.col("doc_id").cast("string"), "claim_id").alias("claim_key"),
        "text",
        (F.col("row_no") - 1).alias("position"),
        F.lit("topic_fact").alias("claim_type"),
    )


def retired_topics(existing: DataFrame, expected: DataFrame) -> DataFrame:
    """Published topic pages that are no longer supported."""
    return existing.where("page_type = 'topic'").join(
        expected.select("kb_id", "slug").distinct(), ["kb_id", "slug"], "left_anti"
    )


def without_retired(aliases: DataFrame, retired: DataFrame) -> DataFrame:
    """Aliases left after the retired pages lost theirs."""
    return aliases.join(retired.select("page_id"), "page_id", "left_anti")


def index_lines(pages: DataFrame) -> DataFrame:
    """The index page of every base as numbered lines: topics, then summaries, by title and slug."""
    heads = (
        pages.select("kb_id")
        .distinct()
        .select(
            "kb_id",
            F.inline(
                F.array(
                    *(
                        F.struct(F.lit(part).alias("part"), F.lit(seq).alias("seq"), F.lit(line).alias("line"))
                        for part, seq, line in (
                            (0, 0, INDEX_TITLE),
                            (0, 1, ""),
                            (0, 2, INDEX_TOPICS),
                            (2, 0, ""),
                            (2, 1, INDEX_SUMMARIES),
                        )
                    )
                )
            ),
        )
        .withColumns({"title": F.lit(""), "slug": F.lit("")})
    )
    links = pages.where(F.col("page_type").isin("topic", "summary")).select(
        "kb_id",
        F.when(F.col("page_type") == "topic", F.lit(1)).otherwise(F.lit(3)).alias("part"),
        F.lit(0).alias("seq"),
        F.concat(F.lit("- [["), "slug", F.lit("|"), "title", F.lit("]]")).alias("line"),
        "title",
        "slug",
    )
    numbered = number_rows(
        heads.unionByName(links), ["kb_id"], ["part", "seq", "title", "slug"], into="line_no"
    )
    return numbered.select("kb_id", "line_no", "line")


def link_graph(contents: DataFrame, targets: DataFrame) -> DataFrame:
    """Out-links `[[slug|title]]` of pages with a dangling mark.

    `contents` is (page_key, content) with one row per page or per page line.
    """
    links = contents.select(
        "page_key",
        F.explode(F.regexp_extract_all("content", F.lit(r"\[\[([^|\]]+)\|[^\]]*\]\]"), F.lit(1))).alias("slug"),
    )
    counted = links.groupBy("page_key", "slug").agg(F.count(F.lit(1)).alias("n_links"))
    known = targets.select("slug").distinct().withColumn("known", F.lit(True))
    return counted.join(known, "slug", "left").select(
        "page_key", "slug", "n_links", F.col("known").isNull().alias("dangling")
    )
