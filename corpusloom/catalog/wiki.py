"""Registered wiki derivation and administration queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.catalog import sql as S
from corpusloom.functions import text as T
from corpusloom.plans import wiki_admin, wiki_build, wiki_generate
from corpusloom.plans.wiki_generate import lead_sentences
from corpusloom.session import pinned, written
from corpusloom.sources import tables, wiki_tables


def merged_claims(spark: SparkSession, folder: str) -> DataFrame:
    drafts = wiki_build.lead_sentence_claims(wiki_tables.active_children(spark, folder))
    merged = wiki_build.merge_claims(drafts)
    place = Window.partitionBy("doc_id").orderBy("position")
    return merged.withColumn("claim_no", F.row_number().over(place))


def faulty_generator(title: str, excerpts: list[tuple[int, str]]) -> tuple[str, int | None]:
    """The default generator, which fails on some documents: no JSON in a later batch, or a source that is not there."""
    number = int(title.rsplit("-", 1)[1])
    if number % 11 == 3 and excerpts[0][0] > 12:
        return "the model has no answer", None
    reply, tokens = lead_sentences(title, excerpts)
    if number % 11 == 5:
        return reply.replace('"source_indices": [', '"source_indices": [99999, ', 1), tokens
    return (f"```json\n{reply}\n```" if number % 2 else reply), tokens


def generated(spark: SparkSession, folder: str) -> wiki_generate.Generated:
    # By version, as the active children lie: by document their texts would be shuffled again.
    titles = tables.documents_dim(spark, folder).select(F.col("active_version_id").alias("version_id"), "title")
    children = written(
        wiki_tables.active_children(spark, folder)
        .select("doc_id", "version_id", "child_index", "chunk_id", "kind", "ordinal", "heading_path", "content")
        .join(titles, "version_id")
    )
    return wiki_generate.generate(children, faulty_generator)


def wiki_generate_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Claims of the versions whose replies are all valid, with the chunks they are bound to."""
    told = generated(spark, folder)
    digests = told.claims.select("doc_id", "version_id", "claim_no", T.short_digest(F.col("text")).alias("text_digest"))
    rows = digests.join(told.sources.drop("doc_id"), ["version_id", "claim_no"])
    return rows.select(
        "doc_id", "version_id", F.col("claim_no").cast("long").alias("claim_no"), "text_digest",
        F.col("source_no").cast("long").alias("source_no"), "chunk_id", F.col("ordinal").cast("long").alias("ordinal"),
        "content_sha256",
    )


def wiki_generate_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Code, tokens and topics of every version that was sent to the generator."""
    told = generated(spark, folder)
    topic = F.concat_ws(":", "topic_no", "name", F.array_join("aliases", "/"), F.array_join(F.col("source_indices").cast("array<string>"), "/"))
    named = told.topics.groupBy("version_id").agg(F.array_join(F.array_sort(F.collect_list(topic)), ",").alias("topics"))
    return told.outcomes.join(named, "version_id", "left").select("doc_id", "version_id", "n_batches", "code", "measured_tokens", "topics")


def claim_merge(spark: SparkSession, folder: str) -> DataFrame:
    return merged_claims(spark, folder).select(
        "doc_id", F.col("claim_no").cast("long").alias("claim_no"), "text",
        F.array_join(F.transform("source_indices", lambda i: i.cast("string")), ",").alias("source_indices"),
    )


def bound_claims(spark: SparkSession, folder: str) -> DataFrame:
    return wiki_build.bind_sources(merged_claims(spark, folder), wiki_tables.active_children(spark, folder))


def claims_grounded(spark: SparkSession, folder: str) -> DataFrame:
    return bound_claims(spark, folder).select(
        "doc_id", "version_id", F.col("claim_no").cast("long").alias("claim_no"),
        F.col("source_no").cast("long").alias("source_no"), "chunk_id",
        F.col("ordinal").cast("long").alias("ordinal"), "content_sha256",
    )


def topic_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Topics drafted per batch (all its long tokens, the most frequent first), merged per document.

    A batch of twelve children holds a few hundred tokens at most, so its window and the place in it are bounded.
    Counting, ranking, merging and the first topics all stay within a document, so the tokens are dealt once by document,
    to so many tasks that each gets a bounded number of documents however large the input is.
    """
    tokens = wiki_tables.long_tokens(spark, folder).select("doc_id", "version_id", "child_index", "token")
    # The key needs Python, which would hide from Spark that the rows are dealt: it comes first.
    tokens = tokens.withColumn("merge_key", T.merge_key(F.col("token")))
    tokens = tables.by_document(tokens, tables.read(spark, folder, "documents").count()).withColumn(
        "batch", wiki_build.batch_number(F.col("child_index"))
    )
    counted = tokens.groupBy("doc_id", "version_id", "batch", "token", "merge_key").agg(
        F.count(F.lit(1)).alias("n"), F.min("child_index").alias("first_child")
    )
    place = Window.partitionBy("doc_id", "version_id", "batch").orderBy(F.desc("n"), "token")
    drafts = counted.withColumn("rank", F.row_number().over(place)).select(
        "doc_id",
        "version_id",
        (F.col("batch") * 1000 + F.col("rank")).alias("position"),
        F.col("token").alias("name"),
        "merge_key",
        F.array(
            F.substring("token", 1, 5), F.col("token"), F.concat(F.substring("token", 1, 3), F.col("batch").cast("string"))
        ).alias("aliases"),
        F.array("first_child").alias("source_indices"),
    )
    return wiki_build.merge_topics(drafts).select(
        "doc_id", F.col("topic_no").cast("long").alias("topic_no"), "name",
        F.array_join("aliases", ",").alias("aliases"),
        F.array_join(F.transform("source_indices", lambda i: i.cast("string")), ",").alias("source_indices"),
    )


def batch_token_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Measured tokens per document; one batch without a measurement leaves the total unknown."""
    children = wiki_tables.active_children(spark, folder)
    batches = children.groupBy("doc_id", wiki_build.batch_number(F.col("child_index")).alias("batch")).agg(
        F.sum("token_count").alias("tokens"), F.max(F.col("content").contains("ouou")).alias("lost")
    )
    measured = F.when(~F.col("lost"), F.col("tokens"))
    return batches.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_batches"), wiki_build.strict_total(measured).cast("long").alias("measured_tokens")
    )


def generation_costs(spark: SparkSession, folder: str) -> DataFrame:
    return wiki_build.generation_cost(wiki_tables.active_children(spark, folder))


def summary_page_render(spark: SparkSession, folder: str) -> DataFrame:
    pages = wiki_build.render_summaries(
        merged_claims(spark, folder), bound_claims(spark, folder), tables.documents_dim(spark, folder)
    )
    return pages.select("doc_id", "title", "content")


def page_alias_set(spark: SparkSession, folder: str) -> DataFrame:
    aliases = wiki_build.page_aliases(wiki_tables.alias_rows(spark, folder))
    return aliases.select("page_id", "alias", "normalized_alias", F.col("position").cast("long").alias("position"))


def with_short_alias(topics: DataFrame) -> DataFrame:
    return topics.withColumn("aliases", F.array(F.substring("name", 1, 5)))


def wiki_topics(spark: SparkSession, folder: str) -> DataFrame:
    return with_short_alias(wiki_tables.topics(spark, folder))


def topic_components(spark: SparkSession, folder: str) -> DataFrame:
    """Topic identities when first and last five letters both count as aliases."""
    topics = wiki_tables.topics(spark, folder).withColumn(
        "aliases", F.array(F.substring("name", 1, 5), F.expr("substring(name, -5)"))
    )
    return wiki_build.topic_identities(topics)


def wiki_topic_parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Topics, their identities and evidence, each written once: several steps read them."""
    mentions = pinned(wiki_tables.topic_mentions(spark, folder))
    topics = with_short_alias(mentions.drop("chunk_ids"))
    identities = pinned(wiki_build.topic_identities(topics))
    evidence = pinned(
        wiki_build.topic_evidence(
            topics,
            identities,
            wiki_tables.topic_sources_of(mentions),
            wiki_tables.claims(spark, folder),
            wiki_tables.claim_sources(spark, folder),
        )
    )
    return topics, identities, evidence


def topic_pages(spark: SparkSession, folder: str) -> DataFrame:
    return wiki_build.topic_pages(*wiki_topic_parts(spark, folder))


def topic_page_lines(spark: SparkSession, folder: str) -> DataFrame:
    topics, identities, evidence = wiki_topic_parts(spark, folder)
    pages = wiki_build.topic_pages(topics, identities, evidence)
    lines = wiki_build.topic_page_lines(pages, evidence, tables.documents_dim(spark, folder))
    return lines.select("kb_id", "slug", F.col("line_no").cast("long").alias("line_no"), "line")


def topic_claims(spark: SparkSession, folder: str) -> DataFrame:
    _, _, evidence = wiki_topic_parts(spark, folder)
    rows = wiki_build.topic_claims(evidence)
    return rows.withColumn("position", F.col("position").cast("long"))


def topic_retired(spark: SparkSession, folder: str) -> DataFrame:
    """Topic pages of an earlier run (every document's topics had one) that are not expected now."""
    expected = topic_pages(spark, folder)
    earlier = wiki_topics(spark, folder).select(
        "kb_id",
        wiki_build.topic_slug(F.substring("name", 1, 5)).alias("slug"),
        F.lit("topic").alias("page_type"),
    ).distinct()
    return wiki_build.retired_topics(earlier, expected).select("kb_id", "slug")


def index_page(spark: SparkSession, folder: str) -> DataFrame:
    pages = wiki_tables.wiki_pages(spark, folder).where("wiki_enabled").select(
        "kb_id", "slug", "title", F.when(F.col("doc_id") % 4 == 0, "topic").otherwise("summary").alias("page_type")
    )
    lines = wiki_build.index_lines(pages)
    return lines.select("kb_id", F.col("line_no").cast("long").alias("line_no"), "line")


def link_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors of the raw pages written as wiki links; names of even pages are known targets."""
    pages = tables.read(spark, folder, "pages", spread=True)
    content = F.regexp_replace("html", r'<a href="/([^"]*)">([^<]*)</a>', "[[$1|$2]]")
    targets = wiki_tables.alias_rows(spark, folder).where("CAST(page_id AS LONG) % 2 = 0").select(
        F.col("alias").alias("slug")
    )
    return wiki_build.link_graph(
        pages.select(F.col("page_id").cast("string").alias("page_key"), content.alias("content")), targets
    )


def page_upsert_review(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("doc_id")
    pages = wiki_tables.wiki_pages(spark, folder)
    digest = T.sha256_hex(F.col("summary"))
    proposals = pages.select(
        "kb_id", "slug", digest.alias("content_digest"), T.sha256_hex(F.col("title")).alias("metadata_digest")
    )
    current = pages.where(number % 11 != 0).select(
        "kb_id",
        "slug",
        "page_id",
        F.concat(F.col("page_id"), F.lit("-v1")).alias("current_version_id"),
        F.when(number % 5 == 0, "user").when(number % 5 == 1, "revert").otherwise("pipeline").alias("origin"),
        F.when(number % 3 == 0, digest).otherwise("old").alias("content_digest"),
        F.when(number % 7 == 0, "old").otherwise(T.sha256_hex(F.col("title"))).alias("metadata_digest"),
    )
    versions = pages.where(number % 11 != 0).select(
        "page_id", F.explode(F.sequence(F.lit(1), (number % 4 + 1).cast("int"))).alias("version_no"), "doc_id"
    ).select(
        "page_id",
        "version_no",
        F.when((F.col("version_no") > 1) & (number % 2 == 0), "pending_review").otherwise("published").alias("review_state"),
    )
    return wiki_admin.upsert_pages(proposals, current, versions)


def action_state(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    pages = wiki_tables.page_fields(spark, folder).select("doc_id", "page_id")
    number = F.col("doc_id")

    def version(no: Column) -> Column:
        return F.concat(F.col("page_id"), F.lit("-v"), no.cast("string"))

    state = pages.where(number % 10 != 9).select("page_id", version(F.lit(1)).alias("current_version_id"))
    versions = pages.select(
        "doc_id", "page_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("version_no")
    ).select(
        version(F.col("version_no")).alias("version_id"),
        "page_id",
        "version_no",
        F.when(F.col("version_no") == 1, "published")
        .when(number % 3 == 0, "rejected")
        .when(number % 3 == 1, "published")
        .otherwise("pending_review")
        .alias("review_state"),
        F.when(number % 8 == 5, version(F.lit(3))).otherwise(version(F.lit(1))).alias("base_published_version_id"),
    )
    action = (
        F.when(number % 4 == 0, "edit").when(number % 4 == 1, "revert").when(number % 4 == 2, "publish").otherwise("reject")
    )
    requests = pages.select(
        number.alias("request_id"),
        action.alias("action"),
        "page_id",
        F.when(number % 6 == 5, version(F.lit(2))).otherwise(version(F.lit(1))).alias("base_version_id"),
        F.when(action != "edit", version((number % 5).cast("int"))).alias("target_version_id"),
    )
    return requests, state, versions


def page_actions(spark: SparkSession, folder: str) -> DataFrame:
    return wiki_admin.page_actions(*action_state(spark, folder))


def page_action_claims(spark: SparkSession, folder: str) -> DataFrame:
    decided = wiki_admin.page_actions(*action_state(spark, folder))
    claims = wiki_tables.claims(spark, folder).select(
        F.concat("page_id", F.lit("-v2")).alias("version_id"),
        F.concat(F.lit("summary-"), (F.col("position") + 1).cast("string")).alias("claim_key"),
        "trust_state",
        "position",
        "claim_type",
    )
    rows = wiki_admin.copied_claims(decided, claims)
    return rows.withColumn("position", F.col("position").cast("long"))


def wiki_configs(spark: SparkSession, folder: str) -> DataFrame:
    number = F.substring("kb_id", 4, 9).cast("long")
    return tables.knowledge_bases(spark, folder).select(
        "kb_id",
        F.col("wiki_enabled").alias("enabled"),
        (30_000 + 10_000 * number).alias("token_limit"),
        (number * 100).alias("tokens_reserved"),
        (number * 1000).alias("tokens_charged"),
    )


def budget_jobs(spark: SparkSession, folder: str) -> DataFrame:
    bases = tables.documents_dim(spark, folder).select("doc_id", "kb_id")
    return wiki_build.generation_cost(wiki_tables.active_children(spark, folder)).join(bases, "doc_id").select(
        "kb_id",
        F.col("doc_id").alias("job_order"),
        F.concat(F.lit("w-"), F.col("doc_id").cast("string")).alias("job_id"),
        "estimate",
    )


def budget_admission(spark: SparkSession, folder: str) -> DataFrame:
    budgets = wiki_configs(spark, folder).select(
        "kb_id", (F.col("token_limit") - F.col("tokens_charged") - F.col("tokens_reserved")).alias("remaining")
    )
    return wiki_admin.admit_within_budget(budget_jobs(spark, folder), budgets)


def wiki_job_admission(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("doc_id")
    hours = (number % 3 - 1).cast("int")
    states = F.array(*(F.lit(s) for s in ("pending", "retry_wait", "running", "succeeded", "pending", "paused_budget")))
    dim = tables.documents_dim(spark, folder)
    version = F.coalesce("active_version_id", F.concat(number.cast("string"), F.lit("-v1")))
    now = tables.as_of()
    jobs = dim.select(
        F.concat(F.lit("w-"), number.cast("string")).alias("job_id"),
        F.when(number % 31 == 0, "src0").otherwise(F.col("kb_id")).alias("kb_id"),
        F.when(number % 23 != 0, version).alias("version_id"),
        F.get(states, (number % 6).cast("int")).alias("status"),
        (now + F.make_dt_interval(hours=hours)).alias("next_retry_at"),
        (now - F.make_dt_interval(mins=(number % 60).cast("int"))).alias("heartbeat_at"),
        (number % 10 == 1).alias("has_checkpoint"),
    )
    counts = tables.chunks(spark, folder).where((F.col("kind") == "child") & (number % 37 != 0)).groupBy(
        "version_id"
    ).agg(F.count(F.lit(1)).alias("n_chunks"))
    rows = wiki_admin.admit_jobs(jobs, wiki_configs(spark, folder), dim, counts, now)
    return rows.select("job_id", "decision")


def wiki_schedule(spark: SparkSession, folder: str) -> DataFrame:
    dim = tables.documents_dim(spark, folder)
    existing = dim.where(F.col("doc_id") % 3 == 0).select(
        F.concat_ws(":", F.lit("wiki"), "active_version_id", F.lit("wiki-v1")).alias("idempotency_key")
    )
    return wiki_admin.schedule_jobs(dim, wiki_configs(spark, folder), existing)


def config_requests(spark: SparkSession, folder: str) -> DataFrame:
    number = F.substring("kb_id", 4, 9).cast("long")
    return wiki_configs(spark, folder).select(
        F.concat(F.lit("q-"), F.col("kb_id")).alias("request_id"),
        "kb_id",
        F.when(number % 5 != 4, number % 3 != 2).alias("enabled"),
        F.when(number % 4 == 1, number * 900).when(number % 4 == 2, number * 20_000).alias("token_limit"),
    )


def wiki_config_updates(spark: SparkSession, folder: str) -> DataFrame:
    configs = wiki_configs(spark, folder).withColumn(
        "token_limit", F.when(F.col("kb_id") == "src3", F.lit(0)).otherwise(F.col("token_limit"))
    )
    return wiki_admin.update_configs(config_requests(spark, folder), configs)


def wiki_jobs_resumed(spark: SparkSession, folder: str) -> DataFrame:
    dim = tables.documents_dim(spark, folder)
    jobs = dim.select(
        F.concat(F.lit("w-"), F.col("doc_id").cast("string")).alias("job_id"),
        "kb_id",
        F.when(F.col("doc_id") % 3 == 0, "paused_budget")
        .when(F.col("doc_id") % 3 == 1, "paused_disabled")
        .otherwise("succeeded")
        .alias("status"),
    )
    return wiki_admin.resumed_jobs(wiki_config_updates(spark, folder), jobs).select("job_id", "kb_id", "status")


def usage_rows(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return tables.read(spark, folder, "events").select(
        F.concat_ws(":", "event_type", F.col("user_id").cast("string"), k.cast("string")).alias("call_key"),
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("kb_id"),
        F.floor(F.col("value") * 10).cast("long").alias("reserved_tokens"),
        F.when(F.col("event_type") != "error", k).alias("measured_tokens"),
        F.col("event_id").alias("usage_no"),
    )


def token_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return wiki_admin.token_ledger(usage_rows(spark, folder), wiki_configs(spark, folder).select("kb_id", "token_limit"))


def wiki_job_listing(spark: SparkSession, folder: str) -> DataFrame:
    events = tables.read(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    jobs = events.where("event_type = 'signup'").select(
        F.col("event_id").alias("job_id"),
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("kb_id"),
        F.col("ts").alias("created_at"),
    )
    usage = events.where(k % 3 != 0).select(
        F.col("event_id").alias("job_id"),
        F.when(k % 5 != 0, k).alias("measured_tokens"),
        F.floor(F.col("value") * 10).cast("long").alias("reserved_tokens"),
    )
    rows = wiki_admin.job_listing(jobs, usage)
    return rows.select("kb_id", "job_id", F.col("place").cast("long").alias("place"), "actual_tokens", "charged_tokens")


def list_pages_keyset(spark: SparkSession, folder: str) -> DataFrame:
    pages = wiki_tables.wiki_pages(spark, folder).withColumn("current_version_id", F.concat("page_id", F.lit("-v1")))
    return wiki_admin.list_pages(pages, "src4", page_type="summary", cursor="p104", limit=50)


QUERIES = {
    "claims_grounded": claims_grounded,
    "claim_merge": claim_merge,
    "wiki_generate_claims": wiki_generate_claims,
    "wiki_generate_outcomes": wiki_generate_outcomes,
    "topic_merge": topic_merge,
    "batch_token_totals": batch_token_totals,
    "generation_costs": generation_costs,
    "summary_page_render": summary_page_render,
    "page_alias_set": page_alias_set,
    "topic_components": topic_components,
    "topic_pages": topic_pages,
    "topic_page_lines": topic_page_lines,
    "topic_claims": topic_claims,
    "topic_retired": topic_retired,
    "index_page": index_page,
    "link_graph": link_graph,
    "page_upsert_review": page_upsert_review,
    "page_actions": page_actions,
    "page_action_claims": page_action_claims,
    "budget_admission": budget_admission,
    "wiki_job_admission": wiki_job_admission,
    "wiki_schedule": wiki_schedule,
    "wiki_config_updates": wiki_config_updates,
    "wiki_jobs_resumed": wiki_jobs_resumed,
    "token_ledger": token_ledger,
    "wiki_job_listing": wiki_job_listing,
    "list_pages_keyset": list_pages_keyset,
}

FIRST_SENTENCE = "coalesce(nullif(trim(regexp_extract({0}, '^[^.!?]+[.!?]?')), ''), {0})"
KEY = "regexp_replace(replace(lower(trim({0})), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_]+', '', 'g')"
ALIAS = "trim(regexp_replace(replace(lower(trim({0})), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"

ACTIVE = """
active_children AS (
  SELECT c.*, c.ordinal - c.section_no AS child_index
  FROM children c JOIN documents_dim d ON d.active_version_id = c.version_id AND NOT d.deleted)"""

MERGED = f"""
drafts AS (
  SELECT doc_id, version_id, child_index, substr(trim({FIRST_SENTENCE.format('content')}), 1, 2000) AS text
  FROM active_children),
merged AS (
  SELECT doc_id, version_id, {KEY.format('text')} AS merge_key, arg_min(text, child_index) AS text,
         min(child_index) AS position, list(child_index ORDER BY child_index) AS source_indices
  FROM drafts GROUP BY ALL),
merged_claims AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS claim_no FROM merged)"""

BOUND = """
cited AS (
  SELECT doc_id, version_id, claim_no, text, unnest(source_indices) AS child_index,
         generate_subscripts(source_indices, 1) - 1 AS source_no FROM merged_claims),
bound AS (
  SELECT x.*, c.chunk_id, c.ordinal, c.kb_id, c.lang, sha256(c.content) AS content_sha256
  FROM cited x JOIN active_children c USING (version_id, child_index))"""

TOKENS = f"""
long_tokens AS (
  SELECT * FROM (SELECT kb_id, doc_id, version_id, chunk_id, child_index,
                        unnest({S.TERMS.format('content')}) AS token FROM active_children)
  WHERE length(token) >= 6),
topics AS (
  SELECT kb_id, doc_id, token AS name, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY kb_id, doc_id ORDER BY n DESC, token) AS rank
    FROM (SELECT kb_id, doc_id, token, count(*) AS n FROM long_tokens GROUP BY ALL)) WHERE rank <= 5)"""

CLAIMS = f"""
claims AS (
  SELECT 'c-' || c.doc_id || '-' || c.section_no AS claim_id, c.doc_id, CAST(c.doc_id AS VARCHAR) AS page_id, c.kb_id,
         c.section_no AS position, {FIRST_SENTENCE.format('c.content')} AS text,
         CASE WHEN coalesce(l.quality, 1) = 1 THEN 'verified' ELSE 'needs_review' END AS trust_state,
         'summary_fact' AS claim_type
  FROM chunks c LEFT JOIN labels l USING (doc_id) WHERE c.kind = 'parent' AND c.version_no = 1),
claim_sources AS (
  SELECT 'c-' || doc_id || '-' || section_no AS claim_id, doc_id, version_id, chunk_id, kind AS chunk_kind,
         ordinal AS chunk_ordinal,
         sha256(CASE WHEN doc_id % 7 = 0 AND child_no > 1 THEN 'stale:' || content ELSE content END) AS content_sha256
  FROM chunks WHERE kind = 'child' AND version_no = 1)"""

EVIDENCE = """
keyed AS (SELECT *, substr(name, 1, 5) AS topic_key FROM topics),
wide AS (
  SELECT kb_id, topic_key, count(DISTINCT doc_id) AS n_documents FROM keyed GROUP BY ALL
  HAVING count(DISTINCT doc_id) >= 2),
evidence AS (
  SELECT DISTINCT k.kb_id, k.topic_key, k.doc_id, c.claim_id, c.text, c.position
  FROM keyed k JOIN wide w USING (kb_id, topic_key)
       JOIN long_tokens t ON t.doc_id = k.doc_id AND t.token = k.name
       JOIN claim_sources s ON s.chunk_id = t.chunk_id
       JOIN claims c ON c.claim_id = s.claim_id AND c.doc_id = k.doc_id
  WHERE c.trust_state = 'verified'),
topic_pages AS (
  SELECT kb_id, topic_key, 'topic/' || substr(sha256(topic_key), 1, 16) AS slug, title, n_documents, n_claims,
         n_documents || ' 篇文档涉及 ' || title AS summary
  FROM (SELECT kb_id, topic_key, arg_min(name, doc_id * 10 + rank) AS title, count(DISTINCT doc_id) AS n_documents
        FROM keyed GROUP BY ALL)
       JOIN (SELECT kb_id, topic_key, count(*) AS n_claims FROM evidence GROUP BY ALL) USING (kb_id, topic_key))"""

PAGES = """
page_fields AS (
  SELECT page_id AS doc_id, CAST(page_id AS VARCHAR) AS page_id,
         'p' || page_id || regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)?', 1) AS slug, 'summary' AS page_type,
         regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title,
         trim(regexp_replace(regexp_extract(html, '(?is)<p>(.*?)</?p>', 1), '<[^>]*>', ' ', 'g')) AS summary,
         list_concat(regexp_extract_all(html, '(?is)<h1>(.*?)</h1>', 1),
                     regexp_extract_all(html, '(?is)<a [^>]*>(.*?)</a>', 1)) AS names
  FROM pages),
alias_rows AS (
  SELECT page_id, title, unnest(names) AS alias, generate_subscripts(names, 1) - 1 AS position FROM page_fields),
page_aliases AS (
  SELECT page_id, trim(alias) AS alias, normalized_alias, position FROM (
    SELECT *, """ + ALIAS.format("alias") + " AS normalized_alias, " + ALIAS.format("title") + """ AS normal_title
    FROM alias_rows)
  WHERE normalized_alias <> '' AND normalized_alias <> normal_title
  QUALIFY row_number() OVER (PARTITION BY page_id, normalized_alias ORDER BY position) = 1),
wiki_pages AS (
  SELECT f.* EXCLUDE (names), d.kb_id, b.enabled, b.wiki_enabled, coalesce(a.aliases, []) AS aliases
  FROM page_fields f JOIN documents_dim d USING (doc_id) JOIN knowledge_bases b USING (kb_id)
       LEFT JOIN (SELECT page_id, list(alias ORDER BY position) AS aliases FROM page_aliases GROUP BY 1) a USING (page_id))"""

CONFIGS = """
wiki_configs AS (
  SELECT kb_id, wiki_enabled AS enabled, n, 30000 + 10000 * n AS token_limit, n * 100 AS tokens_reserved,
         n * 1000 AS tokens_charged
  FROM (SELECT *, CAST(substr(kb_id, 4) AS BIGINT) AS n FROM knowledge_bases))"""

COSTS = """
costs AS (
  SELECT doc_id, version_id, kb_id, n_chunks, calls, CAST(input + 1500 * calls AS BIGINT) AS estimate
  FROM (SELECT *, CAST(list_sum([ceil(n_chunks / 12.0)] || [CASE WHEN ceil(n_chunks / pow(12, k)) > 1
                 THEN ceil(n_chunks / pow(12, k + 1)) ELSE 0 END FOR k IN range(1, 8)]) AS BIGINT) AS calls
        FROM (SELECT doc_id, version_id, kb_id, count(*) AS n_chunks, sum(least(length(content), 1600)) AS input
              FROM active_children GROUP BY ALL)))"""

ACTIONS = """
action_requests AS (
  SELECT page_id AS request_id, CASE page_id % 4 WHEN 0 THEN 'edit' WHEN 1 THEN 'revert' WHEN 2 THEN 'publish'
           ELSE 'reject' END AS action, CAST(page_id AS VARCHAR) AS page_id, page_id AS n,
         page_id || CASE WHEN page_id % 6 = 5 THEN '-v2' ELSE '-v1' END AS base,
         CASE WHEN page_id % 4 <> 0 THEN page_id || '-v' || page_id % 5 END AS target,
         CASE WHEN page_id % 10 <> 9 THEN page_id || '-v1' END AS current, page_id % 5 AS target_no
  FROM pages),
action_joined AS (
  SELECT *, target_no BETWEEN 1 AND 3 AND action <> 'edit' AS has_target,
         CASE WHEN target_no = 1 THEN 'published' WHEN n % 3 = 0 THEN 'rejected' WHEN n % 3 = 1 THEN 'published'
              ELSE 'pending_review' END AS state,
         n || CASE WHEN n % 8 = 5 THEN '-v3' ELSE '-v1' END AS target_base,
         CASE action WHEN 'publish' THEN 'published' WHEN 'reject' THEN 'rejected' END AS final
  FROM action_requests),
action_decided AS (
  SELECT *, CASE WHEN current IS NULL THEN 'wiki_page_not_found'
              WHEN action IN ('edit', 'revert') AND current <> base THEN 'wiki_version_conflict'
              WHEN action <> 'edit' AND NOT has_target THEN 'wiki_page_version_not_found'
              WHEN action = 'revert' AND target = base THEN 'wiki_revert_current_version'
              WHEN state = final THEN 'repeated'
              WHEN final IS NOT NULL AND state <> 'pending_review' THEN 'wiki_candidate_not_pending'
              WHEN final IS NOT NULL AND (current <> base OR target_base <> base) THEN 'wiki_version_conflict'
              WHEN action = 'edit' THEN 'edited' WHEN action = 'revert' THEN 'reverted' ELSE final END AS decision
  FROM action_joined)"""

CONFIG_UPDATES = """
config_state AS (
  SELECT *, CASE WHEN n % 5 <> 4 THEN n % 3 <> 2 END AS want,
         CASE WHEN n % 4 = 1 THEN n * 900 WHEN n % 4 = 2 THEN n * 20000 END AS new_limit,
         CASE WHEN kb_id = 'src3' THEN 0 ELSE token_limit END AS old_limit FROM wiki_configs),
config_decided AS (
  SELECT *, CASE WHEN new_limit < tokens_charged + tokens_reserved THEN 'token_limit_below_usage'
              WHEN want AND coalesce(new_limit, old_limit) <= 0 THEN 'token_limit_required' ELSE 'ok' END AS decision
  FROM config_state),
config_updates AS (
  SELECT 'q-' || kb_id AS request_id, kb_id, decision,
         CASE WHEN decision = 'ok' THEN coalesce(want, enabled) ELSE enabled END AS enabled,
         CASE WHEN decision = 'ok' THEN coalesce(new_limit, old_limit) ELSE old_limit END AS token_limit,
         decision = 'ok' AND coalesce(want, enabled) AND NOT enabled AS schedule_documents,
         decision = 'ok' AND coalesce(want, enabled) AND (NOT enabled OR coalesce(new_limit, old_limit) > old_limit)
           AS resume_paused
  FROM config_decided)"""

ACTIVE_PARTS = (S.BASES, S.DIM, S.CHUNKS, ACTIVE)
TOPIC_PARTS = (*ACTIVE_PARTS, TOKENS, CLAIMS, EVIDENCE)

GENERATED = f"""
said AS (
  SELECT *, (child_index - 1) // 12 AS batch, substr(trim({FIRST_SENTENCE.format('content')}), 1, 2000) AS told FROM active_children),
batch_codes AS (
  SELECT doc_id, version_id, batch,
         CASE WHEN doc_id % 11 = 3 AND batch > 0 THEN 'invalid_json' WHEN count(*) FILTER (told <> '') = 0 THEN 'invalid_shape'
              WHEN doc_id % 11 = 5 THEN 'invalid_source' END AS code,
         CASE WHEN NOT (doc_id % 11 = 3 AND batch > 0) AND NOT bool_or(contains(content, 'ouou'))
              THEN sum(greatest(1, (length(content) + 3) // 4)) END AS tokens
  FROM said GROUP BY doc_id, version_id, batch),
outcomes AS (
  SELECT doc_id, version_id, count(*) AS n_batches, arg_min(code, batch) FILTER (code IS NOT NULL) AS code,
         CAST(CASE WHEN count(*) = count(tokens) THEN sum(tokens) END AS BIGINT) AS measured_tokens
  FROM batch_codes GROUP BY 1, 2),
told_claims AS (
  SELECT doc_id, version_id, {KEY.format('told')} AS merge_key, arg_min(told, child_index) AS text, min(child_index) AS position,
         list(child_index ORDER BY child_index) AS source_indices
  FROM said SEMI JOIN (SELECT version_id FROM outcomes WHERE code IS NULL) USING (version_id) WHERE told <> '' GROUP BY ALL),
told_words AS (
  SELECT doc_id, version_id, batch, word, min(child_index) AS first_child,
         row_number() OVER (PARTITION BY version_id, batch ORDER BY count(*) DESC, word) AS rank
  FROM (SELECT *, unnest(regexp_extract_all(lower(content), '[a-z0-9]{{6,}}')) AS word FROM said)
       SEMI JOIN (SELECT version_id FROM outcomes WHERE code IS NULL) USING (version_id)
  GROUP BY doc_id, version_id, batch, word),
told_topics AS (
  SELECT version_id, word, min(batch * 100 + rank) AS position, string_agg(first_child, '/' ORDER BY batch) AS sources
  FROM told_words WHERE rank <= 5 GROUP BY 1, 2),
topic_lines AS (
  SELECT version_id, no || ':' || word || ':' || substr(word, 1, 5) || ':' || sources AS line
  FROM (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY position) AS no FROM told_topics) WHERE no <= 5)"""

SQL = {
    "wiki_generate_claims": S.sql(
        *ACTIVE_PARTS, GENERATED,
        """numbered AS (
  SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY position) AS claim_no FROM told_claims),
cited AS (
  SELECT doc_id, version_id, claim_no, text, unnest(source_indices) AS child_index,
         generate_subscripts(source_indices, 1) - 1 AS source_no FROM numbered)""",
        select="""
SELECT x.doc_id, version_id, claim_no, substr(sha256(x.text), 1, 16) AS text_digest, source_no, c.chunk_id, c.ordinal,
       sha256(c.content) AS content_sha256
FROM cited x JOIN active_children c USING (version_id, child_index)""",
    ),
    "wiki_generate_outcomes": S.sql(
        *ACTIVE_PARTS, GENERATED,
        select="""
SELECT doc_id, version_id, n_batches, code, measured_tokens, string_agg(line, ',' ORDER BY line) AS topics
FROM outcomes LEFT JOIN topic_lines USING (version_id) GROUP BY ALL""",
    ),
    "claim_merge": S.sql(
        *ACTIVE_PARTS, MERGED,
        select="SELECT doc_id, claim_no, text, array_to_string(source_indices, ',') AS source_indices FROM merged_claims",
    ),
    "claims_grounded": S.sql(
        *ACTIVE_PARTS, MERGED, BOUND,
        select="SELECT doc_id, version_id, claim_no, source_no, chunk_id, ordinal, content_sha256 FROM bound",
    ),
    "topic_merge": S.sql(
        *ACTIVE_PARTS, TOKENS,
        """counted AS (
  SELECT doc_id, version_id, (child_index - 1) // 12 AS batch, token, count(*) AS n, min(child_index) AS first_child
  FROM long_tokens GROUP BY ALL),
drafted AS (
  SELECT *, batch * 1000 + rank AS position FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, version_id, batch ORDER BY n DESC, token) AS rank FROM counted)),
merged_topics AS (
  SELECT doc_id, token AS name, min(position) AS position, min(token) AS t,
         list(substr(token, 1, 3) || batch ORDER BY position) AS tails,
         list(first_child ORDER BY position) AS children
  FROM drafted GROUP BY doc_id, version_id, token)""",
        select="""
SELECT doc_id, topic_no, name, array_to_string([substr(name, 1, 5)] || tails, ',') AS aliases,
       array_to_string(children, ',') AS source_indices
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS topic_no FROM merged_topics)
WHERE topic_no <= 5""",
    ),
    "batch_token_totals": S.sql(
        *ACTIVE_PARTS,
        """batches AS (
  SELECT doc_id, (child_index - 1) // 12 AS batch, sum(greatest(1, (length(content) + 3) // 4)) AS tokens,
         bool_or(contains(content, 'ouou')) AS lost FROM active_children GROUP BY ALL)""",
        select="""
SELECT doc_id, count(*) AS n_batches, CAST(CASE WHEN NOT bool_or(lost) THEN sum(tokens) END AS BIGINT) AS measured_tokens
FROM batches GROUP BY 1""",
    ),
    "generation_costs": S.sql(
        *ACTIVE_PARTS, COSTS, select="SELECT doc_id, version_id, n_chunks, calls, estimate FROM costs"
    ),
    "summary_page_render": S.sql(
        *ACTIVE_PARTS, MERGED, BOUND,
        """marks AS (
  SELECT *, 'claim-' || claim_no || '-source-' || (source_no + 1) AS mark FROM bound),
bullets AS (
  SELECT doc_id, claim_no, '- ' || text || ' ' || string_agg('[^' || mark || ']', ' ' ORDER BY source_no) AS line
  FROM marks GROUP BY doc_id, claim_no, text),
bodies AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY claim_no) AS body FROM bullets GROUP BY 1),
notes AS (
  SELECT doc_id, string_agg('[^' || mark || ']: 原文分块 ' || (ordinal + 1) || '（' || kb_id || ' / ' || lang || '）',
                            chr(10) ORDER BY claim_no, source_no) AS notes FROM marks GROUP BY 1)""",
        select="""
SELECT doc_id, title, '# ' || title || chr(10) || chr(10) || '## 摘要' || chr(10) || body || chr(10) || chr(10)
       || '## 来源' || chr(10) || chr(10) || notes AS content
FROM bodies JOIN notes USING (doc_id) JOIN documents_dim USING (doc_id)""",
    ),
    "page_alias_set": S.sql(
        S.BASES, S.DIM, PAGES, select="SELECT page_id, alias, normalized_alias, position FROM page_aliases"
    ),
    "topic_components": S.sql(
        *ACTIVE_PARTS, TOKENS,
        """links AS (
  SELECT DISTINCT kb_id, name AS u, unnest([substr(name, 1, 5), right(name, 5)]) AS v FROM topics),
edges AS MATERIALIZED (SELECT * FROM links UNION SELECT kb_id, v, u FROM links),
labels(kb_id, node, label) USING KEY (kb_id, node) AS (
  SELECT DISTINCT kb_id, u, u FROM edges
  UNION
  SELECT e.kb_id, e.v, min(l.label)
  FROM labels l JOIN edges e ON e.kb_id = l.kb_id AND e.u = l.node
       JOIN recurring.labels r ON r.kb_id = e.kb_id AND r.node = e.v
  WHERE l.label < r.label GROUP BY e.kb_id, e.v)""",
        select="""
SELECT DISTINCT t.kb_id, t.name, l.label AS topic_key FROM topics t JOIN labels l ON l.kb_id = t.kb_id AND l.node = t.name""",
        recursive=True,
    ),
    "topic_pages": S.sql(
        *TOPIC_PARTS,
        select="SELECT kb_id, topic_key, slug, title, n_documents, n_claims, summary FROM topic_pages",
    ),
    "topic_page_lines": S.sql(
        *TOPIC_PARTS,
        """sections_used AS (
  SELECT DISTINCT e.kb_id, e.topic_key, e.doc_id, d.title FROM evidence e JOIN documents_dim d USING (doc_id)),
page_rows AS (
  SELECT kb_id, topic_key, -1 AS doc_id, unnest([0, 1, 2]) AS part, 0 AS position, '' AS claim_id,
         unnest(['# ' || title, '', '来自多篇文档的相关内容：']) AS line FROM topic_pages
  UNION ALL
  SELECT kb_id, topic_key, doc_id, unnest([0, 1, 2, 4, 5]), 0, '',
         unnest(['', '## ' || title, '', '', '参见 [[summary/' || doc_id || '|' || title || ']]']) FROM sections_used
  UNION ALL
  SELECT kb_id, topic_key, doc_id, 3, position, claim_id, '- ' || text FROM evidence)""",
        select="""
SELECT kb_id, 'topic/' || substr(sha256(topic_key), 1, 16) AS slug, line,
       row_number() OVER (PARTITION BY kb_id, topic_key ORDER BY doc_id, part, position, claim_id) AS line_no
FROM page_rows""",
    ),
    "topic_claims": S.sql(
        *TOPIC_PARTS,
        select="""
SELECT kb_id, 'topic/' || substr(sha256(topic_key), 1, 16) AS slug, doc_id || ':' || claim_id AS claim_key, text,
       row_number() OVER (PARTITION BY kb_id, topic_key ORDER BY doc_id, position, claim_id) - 1 AS position,
       'topic_fact' AS claim_type
FROM evidence""",
    ),
    "topic_retired": S.sql(
        *TOPIC_PARTS,
        select="""
SELECT DISTINCT kb_id, 'topic/' || substr(sha256(substr(name, 1, 5)), 1, 16) AS slug FROM topics
EXCEPT SELECT kb_id, slug FROM topic_pages""",
    ),
    "index_page": S.sql(
        S.BASES, S.DIM, PAGES,
        """listed AS (
  SELECT kb_id, slug, title, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 3 END AS part FROM wiki_pages WHERE wiki_enabled),
index_rows AS (
  SELECT kb_id, unnest([0, 0, 0, 2, 2]) AS part, unnest([0, 1, 2, 0, 1]) AS seq, '' AS title, '' AS slug,
         unnest(['# Wiki 目录', '', '## 主题', '', '## 文档摘要']) AS line FROM (SELECT DISTINCT kb_id FROM listed)
  UNION ALL SELECT kb_id, part, 0, title, slug, '- [[' || slug || '|' || title || ']]' FROM listed)""",
        select="""
SELECT kb_id, line, row_number() OVER (PARTITION BY kb_id ORDER BY part, seq, title, slug) AS line_no FROM index_rows""",
    ),
    "link_graph": S.sql(
        S.BASES, S.DIM, PAGES,
        """links AS (
  SELECT CAST(page_id AS VARCHAR) AS page_key, unnest(regexp_extract_all(
    regexp_replace(html, '<a href="/([^"]*)">([^<]*)</a>', '[[\\1|\\2]]', 'g'), '\\[\\[([^|\\]]+)\\|[^\\]]*\\]\\]', 1)) AS slug
  FROM pages),
targets AS (SELECT DISTINCT alias AS slug FROM alias_rows WHERE CAST(page_id AS BIGINT) % 2 = 0)""",
        select="""
SELECT page_key, slug, count(*) AS n_links, slug NOT IN (SELECT slug FROM targets) AS dangling FROM links GROUP BY ALL""",
    ),
    "page_upsert_review": S.sql(
        S.BASES, S.DIM, PAGES,
        """judged AS (
  SELECT *, doc_id % 11 <> 0 AS known,
         CASE WHEN doc_id % 11 = 0 THEN 'published' WHEN doc_id % 3 = 0 AND doc_id % 7 <> 0 THEN 'unchanged'
              WHEN doc_id % 5 IN (0, 1) THEN 'pending_review' ELSE 'published' END AS decision FROM wiki_pages)""",
        select="""
SELECT kb_id, slug, decision,
       CASE WHEN decision <> 'unchanged' THEN CASE WHEN known THEN doc_id % 4 + 2 ELSE 1 END END AS version_no,
       CASE WHEN decision = 'pending_review' AND doc_id % 2 = 0 THEN doc_id % 4 ELSE 0 END AS superseded,
       CASE WHEN decision <> 'unchanged' AND known THEN page_id || '-v1' END AS base_version_id
FROM judged""",
    ),
    "page_actions": S.sql(
        ACTIONS,
        select="""
SELECT request_id, page_id, action, decision,
       CASE WHEN decision IN ('edited', 'reverted') THEN 4 END AS new_version_no,
       CASE WHEN decision = 'reverted' THEN target END AS claims_from_version,
       CASE WHEN decision = 'published' THEN target END AS now_current
FROM action_decided""",
    ),
    "page_action_claims": S.sql(
        S.CHUNKS, CLAIMS, ACTIONS,
        select="""
SELECT a.page_id, 4 AS new_version_no, 'summary-' || (c.position + 1) AS claim_key, c.trust_state, c.position, c.claim_type
FROM action_decided a JOIN claims c ON c.page_id || '-v2' = a.target WHERE a.decision = 'reverted'
UNION ALL
SELECT page_id, 4, 'manual-content', 'needs_review', 0, 'manual' FROM action_decided WHERE decision = 'edited'""",
    ),
    "budget_admission": S.sql(
        *ACTIVE_PARTS, COSTS, CONFIGS,
        """queue AS MATERIALIZED (
  SELECT c.kb_id, 'w-' || c.doc_id AS job_id, c.estimate, row_number() OVER (PARTITION BY c.kb_id ORDER BY c.doc_id) AS n,
         w.token_limit - w.tokens_charged - w.tokens_reserved AS budget
  FROM costs c JOIN wiki_configs w USING (kb_id)),
walk(kb_id, job_id, n, admitted, remaining) AS (
  SELECT kb_id, job_id, n, estimate <= budget, budget - CASE WHEN estimate <= budget THEN estimate ELSE 0 END
  FROM queue WHERE n = 1
  UNION ALL
  SELECT q.kb_id, q.job_id, q.n, q.estimate <= w.remaining,
         w.remaining - CASE WHEN q.estimate <= w.remaining THEN q.estimate ELSE 0 END
  FROM walk w JOIN queue q ON q.kb_id = w.kb_id AND q.n = w.n + 1)""",
        select="SELECT kb_id, job_id, admitted FROM walk",
        recursive=True,
    ),
    "wiki_job_admission": S.sql(
        S.BASES, S.DIM, S.CHUNKS,
        """counted AS (SELECT version_id, count(*) AS n FROM chunks WHERE kind = 'child' AND doc_id % 37 <> 0 GROUP BY 1),
wiki_job AS (
  SELECT doc_id, CASE WHEN doc_id % 31 = 0 THEN 'src0' ELSE kb_id END AS kb_id, kb_id AS own_kb,
         CASE WHEN doc_id % 23 <> 0 THEN coalesce(active_version_id, doc_id || '-v1') END AS version_id,
         active_version_id IS NOT NULL AND NOT deleted AS source_ok FROM documents_dim)""",
        select="""
SELECT 'w-' || j.doc_id AS job_id,
       CASE WHEN j.doc_id % 6 IN (3, 5) THEN 'skipped'
            WHEN j.doc_id % 6 = 1 AND j.doc_id % 3 = 2 THEN 'not_due'
            WHEN j.doc_id % 6 = 2 AND j.doc_id % 60 < 35 THEN 'alive'
            WHEN NOT b.wiki_enabled THEN 'paused_disabled'
            WHEN j.version_id IS NULL THEN 'wiki_missing_source_version'
            WHEN NOT j.source_ok OR j.own_kb <> j.kb_id THEN 'superseded'
            WHEN c.n IS NULL THEN 'wiki_no_source_chunks'
            WHEN j.doc_id % 10 = 1 THEN 'resume_publishing' ELSE 'reserve_budget' END AS decision
FROM wiki_job j JOIN knowledge_bases b USING (kb_id) LEFT JOIN counted c USING (version_id)""",
    ),
    "wiki_schedule": S.sql(
        S.BASES, S.DIM,
        select="""
SELECT 'wiki:' || active_version_id || ':wiki-v1' AS idempotency_key, kb_id, active_version_id AS version_id
FROM documents_dim JOIN knowledge_bases USING (kb_id)
WHERE wiki_enabled AND status = 'ready' AND NOT deleted AND doc_id % 3 <> 0""",
    ),
    "wiki_config_updates": S.sql(S.BASES, CONFIGS, CONFIG_UPDATES, select="SELECT * FROM config_updates"),
    "wiki_jobs_resumed": S.sql(
        S.BASES, S.DIM, CONFIGS, CONFIG_UPDATES,
        select="""
SELECT 'w-' || doc_id AS job_id, kb_id, 'pending' AS status FROM documents_dim JOIN config_updates USING (kb_id)
WHERE resume_paused AND doc_id % 3 <> 2""",
    ),
    "token_ledger": S.sql(
        S.BASES, CONFIGS,
        """usage_rows AS (
  SELECT event_type || ':' || user_id || ':' || CAST(json_extract(props, '$.k') AS VARCHAR) AS call_key,
         'src' || user_id % 20 AS kb_id, CAST(floor(value * 10) AS BIGINT) AS reserved,
         CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS measured, event_id
  FROM events),
once AS (SELECT * FROM usage_rows QUALIFY row_number() OVER (PARTITION BY call_key ORDER BY event_id) = 1),
totals AS (
  SELECT kb_id, count(*) AS calls, sum(coalesce(measured, reserved)) AS charged, sum(reserved) AS reserved FROM once GROUP BY 1)""",
        select="""
SELECT kb_id, coalesce(calls, 0) AS calls, CAST(coalesce(charged, 0) AS BIGINT) AS tokens_charged,
       CAST(coalesce(reserved, 0) AS BIGINT) AS tokens_reserved,
       CAST(token_limit - coalesce(charged, 0) AS BIGINT) AS remaining
FROM wiki_configs LEFT JOIN totals USING (kb_id)""",
    ),
    "wiki_job_listing": """
WITH j AS (
  SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'src' || user_id % 20 AS kb_id,
         row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts DESC, event_id DESC) AS place
  FROM events WHERE event_type = 'signup')
SELECT kb_id, event_id AS job_id, place, CASE WHEN k % 3 <> 0 AND k % 5 <> 0 THEN k END AS actual_tokens,
       CASE WHEN k % 3 = 0 THEN 0 WHEN k % 5 <> 0 THEN k ELSE CAST(floor(value * 10) AS BIGINT) END AS charged_tokens
FROM j WHERE place <= 50""",
    "list_pages_keyset": S.sql(
        S.BASES, S.DIM, PAGES,
        select="""
SELECT page_id, kb_id, slug, page_type, title FROM wiki_pages
WHERE kb_id = 'src4' AND page_type = 'summary' AND slug > 'p104' ORDER BY slug LIMIT 50""",
    ),
}
