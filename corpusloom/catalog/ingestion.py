"""Registered ingestion and version-state queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.catalog import sql as S
from corpusloom.functions import text as T
from corpusloom.plans import ingest
from corpusloom.plugins import hash_embedder
from corpusloom.session import checkpoint_root
from corpusloom.sources import sinks, tables, uploads, version_table

MAX_UPLOAD_BYTES = 20_000


def kb_document_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = ingest.base_counts(
        tables.knowledge_bases(spark, folder).select("kb_id", "enabled"),
        tables.documents_dim(spark, folder).withColumn(
            "status", F.when(F.col("doc_id") % 5 == 0, "processing").otherwise(F.col("status"))
        ),
    )
    return counted.select("kb_id", "enabled", "document_count", "processing_count")


def content_fingerprint_dups(spark: SparkSession, folder: str) -> DataFrame:
    docs = tables.read(spark, folder, "documents", spread=True).select(
        "doc_id", F.col("source").alias("kb_id"), T.sha256_hex(F.col("text")).alias("sha256")
    )
    return ingest.duplicate_report(docs)


def raw_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Uploads made from documents and pages: several names, MIME types, signatures, encodings."""
    number = F.col("doc_id").cast("string")
    stem = F.concat(F.lit("doc-"), number)
    kind = F.col("doc_id") % 8
    name = (
        F.when(kind == 0, F.concat(F.lit("a\\b\\"), stem, F.lit(".txt")))
        .when(kind == 1, F.concat(F.lit("dir/"), stem, F.lit(".md")))
        .when(kind == 2, F.concat(stem, F.lit(".pdf")))
        .when(kind == 3, F.concat(stem, F.lit(".TXT")))
        .when(kind == 4, F.concat(stem, F.lit(".exe")))
        .when(kind == 5, F.lit(".txt"))
        .when(kind == 6, F.lit("dir/ .md"))
        .otherwise(F.concat(stem, F.lit(".docx")))
    )
    mime = (
        F.when(F.col("doc_id") % 9 == 0, "application/octet-stream")
        .when(kind == 2, " Application/PDF ")
        .when(kind.isin(1, 6), "text/markdown")
        .when(kind == 7, uploads.MIME_BY_SUFFIX[".docx"])
        .otherwise("text/plain; charset=utf-8")
    )
    body = F.encode("text", "utf-8")
    content = (
        F.when(F.col("doc_id") % 10 == 0, F.lit(b""))
        .when(F.col("doc_id") % 11 == 0, F.concat(F.lit(b"\xff"), body))
        .when(F.col("doc_id") % 16 == 2, F.concat(F.lit(b"%PDF-"), body))
        .otherwise(body)
    )
    docs = tables.read(spark, folder, "documents", spread=True).select(
        F.concat(F.lit("d"), number).alias("upload_id"),
        name.alias("filename"),
        mime.alias("declared_mime"),
        content.alias("content"),
    )
    page = F.col("page_id").cast("string")
    pages = tables.read(spark, folder, "pages", spread=True).select(
        F.concat(F.lit("p"), page).alias("upload_id"),
        F.concat(F.lit("page-"), page, F.lit(".html")).alias("filename"),
        F.lit("text/html").alias("declared_mime"),
        F.encode("html", "utf-8").alias("content"),
    )
    return docs.unionByName(pages)


def upload_validation(spark: SparkSession, folder: str) -> DataFrame:
    checked = uploads.validate(raw_uploads(spark, folder), MAX_UPLOAD_BYTES)
    return checked.select(
        "upload_id", "code", "suffix", "mime_type", "sha256", "title", "size",
        T.safe_filename(F.col("filename")).alias("safe_name"),
    )


def section_split_html(spark: SparkSession, folder: str) -> DataFrame:
    pages = tables.read(spark, folder, "pages", spread=True)
    split = pages.select("page_id", uploads.html_sections(F.col("html")).alias("sections"))
    return split.select("page_id", F.inline("sections")).select(
        "page_id",
        F.col("section_no").cast("long").alias("section_no"),
        F.array_join("heading_path", " > ").alias("heading"),
        "text",
    )


def chunk_parent_child(spark: SparkSession, folder: str) -> DataFrame:
    return tables.chunks(spark, folder).select(
        "version_id", F.col("ordinal").cast("long").alias("ordinal"), "kind", "chunk_id", "parent_chunk_id",
        T.sha256_hex(F.col("content")).alias("content_sha256"), "embedding_text",
        F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"),
        F.col("token_count").cast("long").alias("token_count"),
    )


def chunk_child_concat_check(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: the children of each parent joined in order must equal the parent."""
    chunks = tables.chunks(spark, folder)
    parent = F.coalesce("parent_chunk_id", "chunk_id")
    grouped = chunks.groupBy("version_id", parent.alias("parent")).agg(
        F.max(F.when(F.col("kind") == "parent", F.col("content"))).alias("whole"),
        F.array_sort(
            F.collect_list(F.when(F.col("kind") == "child", F.struct("ordinal", "content")))
        ).alias("parts"),
    )
    joined = F.array_join(F.transform("parts", lambda p: p["content"]), "")
    return grouped.groupBy("version_id").agg(
        F.count(F.lit(1)).alias("n_parents"),
        F.sum(F.size("parts")).cast("long").alias("n_children"),
        F.count_if(joined != F.col("whole")).alias("broken"),
    )


def section_line_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Line span of every section of a page's text, lines standing in for pages."""
    pages = tables.read(spark, folder, "pages", spread=True)
    lines = F.filter(
        F.transform(F.split(uploads.html_to_marked(F.col("html")), "\n"), lambda x: T.strip(x)),
        lambda x: x != "",
    )
    items = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(lines).alias("page_no", "line"))
    numbered = items.withColumn("section_no", F.floor(F.col("page_no") / 5))
    return uploads.section_spans(numbered).select(
        F.col("doc_id").alias("page_id"), "section_no",
        F.col("page_start").cast("long").alias("first_line"), F.col("page_end").cast("long").alias("last_line"),
    )


def indexed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """An index with gaps: some versions miss their last child, a few rows have no version."""
    rows = tables.children(spark, folder)
    last = (F.col("doc_id") % 19 == 0) & (F.col("ordinal") == 1)
    extra = tables.read(spark, folder, "embeddings").where("label = 3").select(
        F.concat(F.lit("gone-"), F.col("vec_id").cast("string")).alias("version_id")
    )
    return rows.where(~last).select("version_id").unionByName(extra)


def index_completeness(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.index_completeness(tables.children(spark, folder), indexed_rows(spark, folder))


def version_build_report(spark: SparkSession, folder: str) -> DataFrame:
    """Build all versions; the embedder refuses texts with a certain letter run."""
    default = hash_embedder(64)

    def embedder(text: Column) -> Column:
        return F.when(~text.contains("ouou"), default(text))

    built = ingest.build_versions(
        tables.sections(spark, folder), embedder, 64, tables.CHILD_CHARACTERS
    )
    stages = ingest.stage_rows(built["outcomes"]).groupBy("version_id").agg(
        F.max("progress").cast("long").alias("progress")
    )
    return built["outcomes"].join(stages, "version_id").select(
        "version_id", "expected_children", "indexed_children", "status", "error_code", "progress"
    )


def digests(spark: SparkSession, folder: str) -> DataFrame:
    return tables.version_texts(spark, folder).select(
        "doc_id", "kb_id", "version_no", "version_id", "version_status",
        T.sha256_hex(F.col("text")).alias("sha256"),
    )


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """One to three jobs per version; only the newest one can be running."""
    versions = digests(spark, folder).select("doc_id", "version_no", "version_id", "version_status")
    doc = F.col("doc_id")
    exploded = versions.withColumn("n", F.explode(F.sequence(F.lit(1), (doc % 3 + 1).cast("int"))))
    newest = F.col("n") == doc % 3 + 1
    status = (
        F.when(~newest, "failed")
        .when(doc % 5 == 0, "running")
        .when(F.col("version_status") == "failed", "failed")
        .otherwise("succeeded")
    )
    kind = F.when(doc % 10 == 0, "retry:").when(doc % 10 == 5, "reindex:").otherwise("ingest:")
    job = F.concat("version_id", F.lit("-j"), F.col("n").cast("string"))
    return exploded.select(
        "version_id",
        job.alias("job_id"),
        (F.col("version_no") * 10 + F.col("n")).alias("created_at"),
        status.alias("status"),
        F.concat(kind, "version_id", F.lit(":"), F.col("n").cast("string")).alias("idempotency_key"),
    )


def version_latest(spark: SparkSession, folder: str) -> DataFrame:
    rows = ingest.latest_versions(digests(spark, folder))
    return rows.select("doc_id", "version_id", "version_status", F.col("version_no").cast("long").alias("version_no"))


def version_next_no(spark: SparkSession, folder: str) -> DataFrame:
    rows = ingest.latest_versions(digests(spark, folder))
    return rows.select("doc_id", F.col("next_version_no").cast("long").alias("next_version_no"))


def activate_versions(spark: SparkSession, folder: str) -> DataFrame:
    dim = tables.documents_dim(spark, folder)
    doc, text = F.col("doc_id"), F.col("doc_id").cast("string")
    second = doc % 13 == 0
    proposals = dim.select(
        "doc_id",
        F.concat(text, F.when(second, "-v2").otherwise("-v1")).alias("version_id"),
        F.when(second, F.concat(text, F.lit("-v1"))).alias("previous_version_id"),
        (doc % 19 != 0).alias("verified"),
    )
    state = dim.withColumn("status", F.when(F.col("deleted"), "deleting").otherwise("processing")).withColumn(
        "active_version_id",
        F.when(doc % 26 == 0, F.lit(None))
        .when(second, F.concat(text, F.lit("-v1")))
        .when(doc % 7 == 0, F.concat(text, F.lit("-v0"))),
    )
    configs = tables.knowledge_bases(spark, folder).select("kb_id", F.col("wiki_enabled").alias("enabled"))
    rows = ingest.activate(proposals, state, configs)
    return rows.select("doc_id", "version_id", "outcome", "invalidate_claims", "cleanup_key", "wiki_key")


def version_failures(spark: SparkSession, folder: str) -> DataFrame:
    failed = digests(spark, folder).where("version_status = 'failed'").select(
        "doc_id",
        "version_id",
        F.when(F.col("doc_id") % 2 == 0, "document_parse_failed").otherwise("ingestion_failed").alias("code"),
    )
    doc = F.col("doc_id")
    state = tables.documents_dim(spark, folder).select(
        "doc_id",
        F.when(F.col("deleted"), "deleting").otherwise("processing").alias("status"),
        F.when(doc % 13 == 0, F.concat(doc.cast("string"), F.lit("-v1"))).alias("active_version_id"),
    )
    return ingest.failure_outcomes(failed, state)


def planned_uploads(spark: SparkSession, folder: str) -> DataFrame:
    doc = F.col("doc_id")
    incoming = tables.read(spark, folder, "documents", spread=True).select(
        F.col("doc_id").alias("upload_id"),
        F.when(doc % 2 == 0, F.col("source"))
        .otherwise(F.concat(F.lit("src"), (doc % 23).cast("string")))
        .alias("kb_id"),
        T.sha256_hex(F.col("text")).alias("sha256"),
        F.when(doc % 3 == 0, "new_version").otherwise("reject").alias("on_duplicate"),
    )
    return ingest.plan_uploads(
        incoming,
        tables.knowledge_bases(spark, folder),
        tables.documents_dim(spark, folder),
        digests(spark, folder).withColumn(
            "version_status",
            F.when((doc % 12 == 0) & (F.col("version_no") == 1), "embedding").otherwise(F.col("version_status")),
        ),
    )


def upload_plan_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return planned_uploads(spark, folder).select(
        "upload_id", "kb_id", "decision", "document_key", F.col("version_no").cast("long").alias("version_no")
    )


def upload_plan_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What accepted uploads add, per base and table."""
    rows = ingest.upload_rows(planned_uploads(spark, folder))
    events = rows["events"].select(
        F.col("event_key").alias("key"), F.get_json_object("payload", "$.job_id").alias("job_id")
    )
    added = rows["jobs"].select(F.col("idempotency_key").alias("key"), "job_id", "version_id")
    return added.join(events, ["key", "job_id"]).select("key", "job_id", "version_id")


def document_action_plan(spark: SparkSession, folder: str) -> DataFrame:
    doc = F.col("doc_id")
    dim = tables.documents_dim(spark, folder)
    requests = dim.select(
        F.concat(F.lit("r"), doc.cast("string")).alias("request_id"),
        "doc_id",
        F.when(doc % 17 == 0, "retry").when(doc % 4 == 1, "rename").otherwise("reindex").alias("action"),
    )
    state = dim.withColumn("status", F.when(doc % 29 == 0, "deleting").otherwise(F.col("status")))
    rows = ingest.plan_actions(requests, state, digests(spark, folder), jobs(spark, folder))
    return rows.select(
        "request_id", "doc_id", "action", "decision", "reused_job_id",
        F.col("work_version_no").cast("long").alias("work_version_no"),
    )


def deletion_plan(spark: SparkSession, folder: str) -> DataFrame:
    doc = F.col("doc_id")
    dim = tables.documents_dim(spark, folder)
    requests = dim.select(
        F.explode(F.sequence(F.lit(0), (doc % 2).cast("int"))).alias("n"), "doc_id"
    ).select((doc * 2 + F.col("n")).alias("request_id"), "doc_id")
    existing = dim.where(doc % 8 == 0).select(
        F.concat(F.lit("delete:"), doc.cast("string")).alias("idempotency_key"),
        F.concat(F.lit("job-"), doc.cast("string")).alias("job_id"),
    )
    return ingest.plan_document_deletion(requests, dim, existing)


def base_deletion_plan(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("page_id")
    requests = tables.read(spark, folder, "pages").select(
        number.alias("request_id"),
        F.concat(F.lit("src"), (number % 24).cast("string")).alias("kb_id"),
        (number % 2 == 0).alias("confirm"),
    )
    bases = tables.knowledge_bases(spark, folder).select("kb_id").unionByName(
        spark.createDataFrame([("src21",)], "kb_id string")
    )
    return ingest.plan_base_deletion(requests, bases, tables.documents_dim(spark, folder))


def base_requests(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("page_id")
    text = number.cast("string")
    requests = tables.read(spark, folder, "pages").select(
        number.alias("request_id"),
        F.when(number % 3 == 0, "rename").otherwise("create").alias("action"),
        F.when(number % 3 == 0, F.concat(F.lit("src"), (number % 25).cast("string"))).alias("kb_id"),
        F.when(number % 4 == 0, F.concat(F.lit(" base-src"), (number % 30).cast("string"), F.lit(" ")))
        .when(number % 4 == 1, F.concat(F.lit("new-"), (number % 40).cast("string")))
        .otherwise(F.concat(F.lit("own-"), text))
        .alias("name"),
    )
    bases = tables.knowledge_bases(spark, folder).select(
        "kb_id", F.concat(F.lit("base-"), F.col("kb_id")).alias("name")
    )
    return ingest.base_requests(requests, bases)


def cleanup_selection(spark: SparkSession, folder: str) -> DataFrame:
    doc = F.col("doc_id")
    versions = digests(spark, folder).withColumn(
        "version_status", F.when(doc % 21 == 0, "indexing").otherwise(F.col("version_status"))
    )
    requests = versions.select("version_id").unionByName(
        versions.where("version_no = 2").select(F.concat("version_id", F.lit("-x")).alias("version_id"))
    )
    return ingest.cleanup_selection(requests, versions, tables.documents_dim(spark, folder))


def orphan_files(spark: SparkSession, folder: str) -> DataFrame:
    versions = digests(spark, folder).withColumn(
        "file_path", F.concat(F.substring("sha256", 1, 16), F.lit(".txt"))
    )
    gone = tables.documents_dim(spark, folder).where("deleted")
    return ingest.orphan_files(versions, gone)


def replace_version_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Index content after the second versions were rebuilt and failed documents were removed."""
    children = tables.children(spark, folder).select("version_id", "chunk_id", "version_no", "doc_id")
    changed = children.where("version_no = 2").select("version_id")
    rebuilt = children.where("version_no = 2").withColumn("chunk_id", F.concat(F.lit("new-"), "chunk_id"))
    gone = digests(spark, folder).where("doc_id % 5 = 0").select("version_id")
    content = sinks.without_versions(sinks.replaced(children, rebuilt, changed), gone)
    return content.groupBy("version_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("chunk_id").alias("first_chunk")
    )


def delete_version_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The written child table after second versions were replaced and failed documents were deleted, twice each."""
    path = f"{checkpoint_root(spark)}/version-table-{uuid.uuid4().hex}"
    children = tables.children(spark, folder).select("version_id", "chunk_id", "version_no", "doc_id", "content")
    version_table.create(children, path)
    first = version_table.read(spark, path)
    changed = first.where("version_no = 2").select("version_id")
    rebuilt = first.where("version_no = 2").withColumn("chunk_id", F.concat(F.lit("new-"), "chunk_id"))
    gone = digests(spark, folder).where("doc_id % 5 = 0").select("version_id")
    for _ in range(2):
        version_table.replace(rebuilt, changed, path)
    for _ in range(2):
        version_table.delete(gone, path)
    version_table.vacuum(spark, path)
    return version_table.read(spark, path).groupBy("version_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("chunk_id").alias("first_chunk"), F.sum(F.length("content")).alias("n_chars")
    )


def insert_only_new(spark: SparkSession, folder: str) -> DataFrame:
    """Events by key: one row per new key; keys below a bound exist already."""
    events = tables.read(spark, folder, "events").select(
        F.concat("event_type", F.lit(":"), F.get_json_object("props", "$.k")).alias("event_key"),
        "event_id",
        "user_id",
    )
    existing = events.where("event_type = 'view'").select("event_key")
    return sinks.only_new(events, existing, ["event_key"])


def document_listing(spark: SparkSession, folder: str) -> DataFrame:
    rows = ingest.document_listing(
        tables.documents_dim(spark, folder), digests(spark, folder), jobs(spark, folder)
    )
    return rows.select("doc_id", "kb_id", "title", "status", "active_version_id", "job_id", "job_status")


def embedding_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Drift report: versions per embedding configuration; older versions used another model."""
    versions = digests(spark, folder)
    model = F.when(F.col("version_no") == 1, "embed-a").when(F.col("doc_id") % 2 == 0, "embed-b")
    mark = T.embedding_fingerprint(F.lit("openai"), model, F.lit(1536))
    return versions.groupBy(mark.alias("fingerprint")).agg(F.count(F.lit(1)).alias("n_versions"))


QUERIES = {
    "kb_document_counts": kb_document_counts,
    "content_fingerprint_dups": content_fingerprint_dups,
    "upload_validation": upload_validation,
    "section_split_html": section_split_html,
    "section_line_spans": section_line_spans,
    "chunk_parent_child": chunk_parent_child,
    "chunk_child_concat_check": chunk_child_concat_check,
    "index_completeness": index_completeness,
    "version_build_report": version_build_report,
    "version_latest": version_latest,
    "version_next_no": version_next_no,
    "activate_versions": activate_versions,
    "version_failures": version_failures,
    "upload_plan_duplicates": upload_plan_duplicates,
    "upload_plan_rows": upload_plan_rows,
    "document_action_plan": document_action_plan,
    "deletion_plan": deletion_plan,
    "base_deletion_plan": base_deletion_plan,
    "base_requests": base_requests,
    "cleanup_selection": cleanup_selection,
    "orphan_files": orphan_files,
    "replace_version_chunks": replace_version_chunks,
    "delete_version_rows": delete_version_rows,
    "insert_only_new": insert_only_new,
    "document_listing": document_listing,
    "embedding_fingerprints": embedding_fingerprints,
}

DIGESTS = """
digests AS (
  SELECT doc_id, kb_id, version_no, version_id, version_status, sha256(text) AS sha256 FROM version_texts)"""

JOBS = """
jobs AS (
  SELECT version_id, doc_id, version_id || '-j' || n AS job_id, version_no * 10 + n AS created_at,
         CASE WHEN n <> doc_id % 3 + 1 THEN 'failed' WHEN doc_id % 5 = 0 THEN 'running'
              WHEN version_status = 'failed' THEN 'failed' ELSE 'succeeded' END AS status,
         CASE doc_id % 10 WHEN 0 THEN 'retry:' WHEN 5 THEN 'reindex:' ELSE 'ingest:' END
           || version_id || ':' || n AS idempotency_key
  FROM (SELECT *, unnest(range(1, doc_id % 3 + 2)) AS n FROM version_texts))"""

MARKED = """
marked AS (
  SELECT page_id, replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      html, '(?is)<!--.*?-->', '', 'g'),
      '(?is)<(?:script|style|head)\\b.*?</(?:script|style|head)>', '', 'g'),
      '\\s+', ' ', 'g'),
      '(?i)<h([1-6])\\b[^>]*>', chr(10) || chr(2) || '\\1', 'g'),
      '(?i)</h[1-6]>', chr(10), 'g'),
      '(?i)</?(?:p|br|div|li|ul|ol|tr|table|article|section|nav|header|footer|blockquote|pre|body)\\b[^>]*>',
      chr(10), 'g'),
      '<[^>]*>', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&') AS body
  FROM pages)"""

UPLOADS = """
raw_uploads AS (
  SELECT 'd' || doc_id AS upload_id,
         CASE doc_id % 8 WHEN 0 THEN 'a\\b\\doc-' || doc_id || '.txt' WHEN 1 THEN 'dir/doc-' || doc_id || '.md'
           WHEN 2 THEN 'doc-' || doc_id || '.pdf' WHEN 3 THEN 'doc-' || doc_id || '.TXT'
           WHEN 4 THEN 'doc-' || doc_id || '.exe' WHEN 5 THEN '.txt' WHEN 6 THEN 'dir/ .md'
           ELSE 'doc-' || doc_id || '.docx' END AS filename,
         CASE WHEN doc_id % 9 = 0 THEN 'application/octet-stream' WHEN doc_id % 8 = 2 THEN 'application/pdf'
              WHEN doc_id % 8 IN (1, 6) THEN 'text/markdown'
              WHEN doc_id % 8 = 7 THEN
                'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
              ELSE 'text/plain' END AS declared,
         CASE WHEN doc_id % 10 = 0 THEN ''::BLOB WHEN doc_id % 11 = 0 THEN '\\xFF'::BLOB || encode(text)
              WHEN doc_id % 16 = 2 THEN encode('%PDF-' || text) ELSE encode(text) END AS content
  FROM documents
  UNION ALL
  SELECT 'p' || page_id, 'page-' || page_id || '.html', 'text/html', encode(html) FROM pages),
named AS (
  SELECT *, lower(regexp_extract(string_split(filename, '/')[-1], '^.+(\\.[^.]+)$', 1)) AS suffix,
         regexp_replace(string_split(filename, '/')[-1], '^(.+)\\.[^.]+$', '\\1') AS stem
  FROM raw_uploads),
checked AS (
  SELECT *, CASE suffix WHEN '.pdf' THEN 'application/pdf' WHEN '.md' THEN 'text/markdown'
              WHEN '.txt' THEN 'text/plain' WHEN '.docx' THEN
                'application/vnd.openxmlformats-officedocument.wordprocessingml.document' END AS expected
  FROM named),
coded AS (
  SELECT *, CASE WHEN expected IS NULL THEN 'unsupported_file_type'
              WHEN declared <> expected THEN 'unsupported_media_type'
              WHEN octet_length(content) = 0 THEN 'empty_file'
              WHEN octet_length(content) > 20000 THEN 'file_too_large'
              WHEN suffix = '.pdf' AND hex(content) NOT LIKE '255044462D%' THEN 'invalid_file_signature'
              WHEN suffix = '.docx' THEN 'invalid_file_signature'
              WHEN suffix IN ('.md', '.txt') AND TRY(decode(content)) IS NULL THEN 'invalid_text_encoding'
            END AS code
  FROM checked)"""

PLANNED = """
incoming AS (
  SELECT doc_id AS upload_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'src' || doc_id % 23 END AS kb_id,
         sha256(text) AS sha256, CASE WHEN doc_id % 3 = 0 THEN 'new_version' ELSE 'reject' END AS on_duplicate
  FROM documents),
held AS (
  SELECT * FROM (
    SELECT d.kb_id, g.sha256, g.doc_id, coalesce(d.active_version_id = g.version_id, false) AS active,
           row_number() OVER (PARTITION BY d.kb_id, g.sha256 ORDER BY g.version_no DESC, g.doc_id) AS nth
    FROM digests g JOIN documents_dim d USING (doc_id)
    WHERE NOT d.deleted AND (d.active_version_id = g.version_id OR
      CASE WHEN g.doc_id % 12 = 0 AND g.version_no = 1 THEN 'embedding' ELSE g.version_status END
        NOT IN ('failed', 'ready'))) WHERE nth = 1),
highest AS (SELECT doc_id, max(version_no) AS highest FROM digests GROUP BY doc_id),
taken AS (
  SELECT i.upload_id, i.kb_id, b.kb_id IS NOT NULL AS known, h.doc_id AS held_doc,
         h.active AS held_active, i.on_duplicate, m.highest,
         CASE WHEN b.kb_id IS NULL THEN NULL
              WHEN h.doc_id IS NULL THEN row_number() OVER (PARTITION BY i.kb_id, i.sha256 ORDER BY i.upload_id)
              WHEN h.active AND i.on_duplicate = 'new_version' THEN row_number() OVER (
                PARTITION BY i.kb_id, i.sha256, i.on_duplicate ORDER BY i.upload_id) END AS nth
  FROM incoming i LEFT JOIN knowledge_bases b USING (kb_id)
       LEFT JOIN held h ON h.kb_id = i.kb_id AND h.sha256 = i.sha256 LEFT JOIN highest m ON m.doc_id = h.doc_id),
decided AS (
  SELECT *, CASE WHEN NOT known THEN 'knowledge_base_not_found' WHEN nth IS NULL OR nth > 1 THEN 'duplicate_document'
              WHEN held_doc IS NULL THEN 'new_document' ELSE 'new_version' END AS decision FROM taken),
planned AS (
  SELECT upload_id, kb_id, decision,
         CASE decision WHEN 'new_document' THEN 'upload-' || upload_id WHEN 'new_version' THEN CAST(held_doc AS VARCHAR)
         END AS document_key,
         CASE decision WHEN 'new_document' THEN 1 WHEN 'new_version' THEN highest + 1 END AS version_no
  FROM decided)"""

SQL = {
    "kb_document_counts": S.sql(
        S.BASES, S.DIM,
        select="""
SELECT b.kb_id, b.enabled, count(d.doc_id) AS document_count,
       count(*) FILTER (d.doc_id % 5 = 0) AS processing_count
FROM knowledge_bases b LEFT JOIN documents_dim d ON d.kb_id = b.kb_id AND NOT d.deleted GROUP BY ALL""",
    ),
    "content_fingerprint_dups": """
SELECT source AS kb_id, sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS keeper
FROM documents GROUP BY ALL HAVING count(*) > 1""",
    "upload_validation": S.sql(
        UPLOADS,
        select="""
SELECT upload_id, code, CASE WHEN code IS NULL THEN suffix END AS suffix,
       CASE WHEN code IS NULL THEN expected END AS mime_type,
       CASE WHEN code IS NULL THEN sha256(content) END AS sha256,
       CASE WHEN code IS NULL THEN coalesce(nullif(trim(stem), ''), 'Untitled') END AS title,
       CASE WHEN code IS NULL THEN octet_length(content) END AS size,
       coalesce(nullif(trim(string_split(replace(filename, '\\', '/'), '/')[-1]), ''), 'upload') AS safe_name
FROM coded""",
    ),
    "section_split_html": S.sql(
        MARKED,
        """parts AS (
  SELECT page_id, unnest(string_split(body, chr(10) || chr(2))) AS piece,
         generate_subscripts(string_split(body, chr(10) || chr(2)), 1) AS n FROM marked),
cut AS (
  SELECT page_id, n, CASE WHEN n > 1 THEN trim(regexp_extract(piece, '^[1-6]([^\\n]*)', 1)) ELSE '' END AS heading,
         trim(CASE WHEN n > 1 THEN regexp_replace(piece, '^[^\\n]*\\n?', '') ELSE piece END,
              ' ' || chr(10)) AS text FROM parts)""",
        select="""
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS section_no, heading, text
FROM cut WHERE text <> ''""",
    ),
    "section_line_spans": S.sql(
        MARKED,
        """body_lines AS (
  SELECT page_id, trim(line) AS line, n FROM (
    SELECT page_id, unnest(string_split(body, chr(10))) AS line,
           generate_subscripts(string_split(body, chr(10)), 1) AS n FROM marked) WHERE trim(line) <> ''),
numbered AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS no FROM body_lines)""",
        select="""
SELECT page_id, no // 5 AS section_no, min(no) AS first_line, max(no) AS last_line
FROM numbered GROUP BY ALL""",
    ),
    "chunk_parent_child": S.sql(
        S.CHUNKS,
        select="""
SELECT version_id, ordinal, kind, chunk_id, parent_chunk_id, sha256(content) AS content_sha256,
       CASE WHEN child_no > 0 THEN kb_id || ' > ' || lang || chr(10) || content END AS embedding_text,
       CASE WHEN child_no > 0 THEN (child_no - 1) * 200 ELSE 0 END AS char_start,
       CASE WHEN child_no > 0 THEN (child_no - 1) * 200 ELSE 0 END + length(content) AS char_end,
       greatest(1, (length(content) + 3) // 4) AS token_count
FROM chunks""",
    ),
    "chunk_child_concat_check": S.sql(
        S.CHUNKS,
        """grouped AS (
  SELECT version_id, section_no, max(content) FILTER (child_no = 0) AS whole,
         string_agg(content, '' ORDER BY ordinal) FILTER (child_no > 0) AS joined,
         count(*) FILTER (child_no > 0) AS n
  FROM chunks GROUP BY ALL)""",
        select="""
SELECT version_id, count(*) AS n_parents, CAST(sum(n) AS BIGINT) AS n_children,
       count(*) FILTER (whole <> joined) AS broken
FROM grouped GROUP BY version_id""",
    ),
    "index_completeness": S.sql(
        S.CHUNKS,
        """expected AS (SELECT version_id, count(*) AS expected FROM children GROUP BY 1),
indexed AS (
  SELECT version_id, count(*) AS indexed FROM (
    SELECT version_id FROM children WHERE NOT (doc_id % 19 = 0 AND ordinal = 1)
    UNION ALL SELECT 'gone-' || vec_id FROM embeddings WHERE label = 3) GROUP BY 1)""",
        select="""
SELECT version_id, coalesce(expected, 0) AS expected, coalesce(indexed, 0) AS indexed,
       CASE WHEN coalesce(expected, 0) = coalesce(indexed, 0) THEN 'activated'
            ELSE 'index_verification_failed' END AS outcome
FROM expected FULL JOIN indexed USING (version_id)""",
    ),
    "version_build_report": S.sql(
        S.CHUNKS,
        """counted AS (
  SELECT v.version_id, count(c.chunk_id) AS expected_children,
         count(c.chunk_id) FILTER (NOT contains(c.kb_id || ' > ' || c.lang || chr(10) || c.content, 'ouou'))
           AS indexed_children
  FROM version_texts v LEFT JOIN chunks c ON c.version_id = v.version_id AND c.kind = 'child' GROUP BY 1),
coded AS (
  SELECT *, CASE WHEN expected_children = 0 THEN 'document_parse_failed'
                 WHEN expected_children <> indexed_children THEN 'index_verification_failed' END AS error_code
  FROM counted)""",
        select="""
SELECT version_id, expected_children, indexed_children,
       CASE WHEN error_code IS NULL THEN 'ready' ELSE 'failed' END AS status, error_code,
       CASE error_code WHEN 'document_parse_failed' THEN 10 WHEN 'index_verification_failed' THEN 75
            ELSE 100 END AS progress
FROM coded""",
    ),
    "version_latest": S.sql(
        S.VERSIONS,
        select="""
SELECT doc_id, version_id, version_status, version_no FROM version_texts
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY version_no DESC) = 1""",
    ),
    "version_next_no": S.sql(
        S.VERSIONS, select="SELECT doc_id, max(version_no) + 1 AS next_version_no FROM version_texts GROUP BY 1"
    ),
    "activate_versions": S.sql(
        S.BASES, S.DIM,
        """proposed AS (
  SELECT *, doc_id || CASE WHEN doc_id % 13 = 0 THEN '-v2' ELSE '-v1' END AS version_id,
         CASE WHEN doc_id % 13 = 0 THEN doc_id || '-v1' END AS previous,
         CASE WHEN doc_id % 26 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN doc_id || '-v1'
              WHEN doc_id % 7 = 0 THEN doc_id || '-v0' END AS current FROM documents_dim),
decided AS (
  SELECT *, CASE WHEN doc_id % 19 = 0 THEN 'index_verification_failed'
              WHEN deleted THEN 'ingestion_document_deleting'
              WHEN current IS DISTINCT FROM previous THEN 'active_version_changed'
              ELSE 'activated' END AS outcome FROM proposed)""",
        select="""
SELECT doc_id, version_id, outcome, outcome = 'activated' AND previous IS NOT NULL AS invalidate_claims,
       CASE WHEN outcome = 'activated' AND previous IS NOT NULL THEN 'cleanup-version:' || previous END AS cleanup_key,
       CASE WHEN outcome = 'activated' AND wiki_enabled THEN 'wiki:' || version_id || ':wiki-v1' END AS wiki_key
FROM decided JOIN knowledge_bases USING (kb_id)""",
    ),
    "version_failures": S.sql(
        S.DIM, S.VERSIONS,
        select="""
SELECT v.doc_id, v.version_id, 'failed' AS version_status,
       CASE WHEN v.doc_id % 2 = 0 THEN 'document_parse_failed' ELSE 'ingestion_failed' END AS error_code,
       CASE WHEN d.deleted THEN 'deleting' WHEN v.doc_id % 13 = 0 THEN 'ready' ELSE 'failed' END AS document_status,
       'failed-version:' || v.version_id AS cleanup_key
FROM version_texts v JOIN documents_dim d USING (doc_id) WHERE v.version_status = 'failed'""",
    ),
    "upload_plan_duplicates": S.sql(
        S.BASES, S.DIM, S.VERSIONS, DIGESTS, PLANNED,
        select="SELECT upload_id, kb_id, decision, document_key, version_no FROM planned",
    ),
    "upload_plan_rows": S.sql(
        S.BASES, S.DIM, S.VERSIONS, DIGESTS, PLANNED,
        select="""
SELECT 'ingest:' || document_key || '-v' || version_no AS key,
       'job:' || document_key || '-v' || version_no AS job_id, document_key || '-v' || version_no AS version_id
FROM planned WHERE document_key IS NOT NULL""",
    ),
    "document_action_plan": S.sql(
        S.DIM, S.VERSIONS, JOBS,
        """newest AS (SELECT * FROM version_texts QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY version_no DESC) = 1),
last_job AS (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY version_id ORDER BY created_at DESC, job_id DESC) = 1),
joined AS (
  SELECT d.doc_id, CASE WHEN d.doc_id % 17 = 0 THEN 'retry' WHEN d.doc_id % 4 = 1 THEN 'rename' ELSE 'reindex' END AS action,
         d.deleted, d.active_version_id, n.version_no, n.version_status, j.job_id, j.status AS job_status,
         j.idempotency_key AS key
  FROM documents_dim d LEFT JOIN newest n USING (doc_id) LEFT JOIN last_job j ON j.version_id = n.version_id),
decided AS (
  SELECT *, CASE WHEN action = 'rename' THEN 'unsupported_document_action' WHEN deleted THEN 'document_not_found'
              WHEN doc_id % 29 = 0 THEN 'document_deleting'
              WHEN starts_with(key, action || ':') AND job_status IN ('pending', 'running', 'retry_wait') THEN 'reused'
              WHEN action = 'retry' AND NOT (version_status = 'failed' AND job_status = 'failed') THEN 'document_not_failed'
              WHEN action = 'reindex' AND active_version_id IS NULL THEN 'document_not_ready'
              ELSE 'scheduled' END AS decision FROM joined)""",
        select="""
SELECT 'r' || doc_id AS request_id, doc_id, action, decision,
       CASE WHEN decision = 'reused' THEN job_id END AS reused_job_id,
       CASE WHEN decision = 'scheduled' THEN version_no + CASE WHEN action = 'reindex' THEN 1 ELSE 0 END END AS work_version_no
FROM decided""",
    ),
    "deletion_plan": S.sql(
        S.DIM,
        """asked AS (SELECT doc_id, deleted, unnest(range(0, doc_id % 2 + 1)) AS n FROM documents_dim)""",
        select="""
SELECT doc_id * 2 + n AS request_id, doc_id,
       CASE WHEN deleted THEN 'document_not_found' WHEN doc_id % 8 = 0 OR n > 0 THEN 'already_deleting'
            ELSE 'deleting' END AS decision, 'delete:' || doc_id AS delete_key
FROM asked""",
    ),
    "base_deletion_plan": S.sql(
        S.BASES, S.DIM,
        """counts AS (
  SELECT b.kb_id, count(d.doc_id) AS n
  FROM (SELECT kb_id FROM knowledge_bases UNION ALL SELECT 'src21') b
       LEFT JOIN documents_dim d ON d.kb_id = b.kb_id AND NOT d.deleted GROUP BY 1),
asked AS (SELECT page_id AS request_id, 'src' || page_id % 24 AS kb_id, page_id % 2 = 0 AS confirm FROM pages)""",
        select="""
SELECT request_id, kb_id,
       CASE WHEN n IS NULL THEN 'knowledge_base_not_found' WHEN n > 0 AND NOT confirm THEN 'knowledge_base_not_empty'
            WHEN n > 0 THEN 'deleting' ELSE 'deleted' END AS decision,
       CASE WHEN n > 0 AND confirm THEN 'delete-kb:' || kb_id END AS event_key
FROM asked LEFT JOIN counts USING (kb_id)""",
    ),
    "base_requests": S.sql(
        S.BASES,
        """asked AS (
  SELECT page_id AS request_id, CASE WHEN page_id % 3 = 0 THEN 'rename' ELSE 'create' END AS action,
         CASE WHEN page_id % 3 = 0 THEN 'src' || page_id % 25 END AS kb_id,
         CASE page_id % 4 WHEN 0 THEN 'base-src' || page_id % 30 WHEN 1 THEN 'new-' || page_id % 40
              ELSE 'own-' || page_id END AS name FROM pages),
joined AS (
  SELECT a.*, a.action = 'rename' AND k.kb_id IS NULL AS missing,
         o.kb_id IS NULL OR (a.action = 'rename' AND o.kb_id = a.kb_id) AS free
  FROM asked a LEFT JOIN knowledge_bases k ON k.kb_id = a.kb_id
       LEFT JOIN knowledge_bases o ON 'base-' || o.kb_id = a.name),
first AS (SELECT name, min(request_id) AS winner FROM joined WHERE NOT missing AND free GROUP BY 1)""",
        select="""
SELECT request_id, action, name,
       CASE WHEN missing THEN 'knowledge_base_not_found' WHEN NOT free OR winner <> request_id
            THEN 'knowledge_base_name_conflict' ELSE 'ok' END AS decision
FROM joined LEFT JOIN first USING (name)""",
    ),
    "cleanup_selection": S.sql(
        S.DIM, S.VERSIONS,
        select="""
SELECT v.version_id, CASE WHEN d.active_version_id = v.version_id THEN 'kept_active'
         WHEN v.doc_id % 21 = 0 THEN 'kept_in_work' ELSE 'remove_index' END AS decision
FROM version_texts v JOIN documents_dim d USING (doc_id)
UNION ALL SELECT version_id || '-x', 'version_not_found' FROM version_texts WHERE version_no = 2""",
    ),
    "orphan_files": S.sql(
        S.DIM, S.VERSIONS, DIGESTS,
        select="""
SELECT DISTINCT substr(sha256, 1, 16) || '.txt' AS file_path
FROM digests JOIN documents_dim d USING (doc_id) WHERE d.deleted""",
    ),
    "replace_version_chunks": S.sql(
        S.CHUNKS,
        select="""
SELECT version_id, count(*) AS n_rows,
       min(CASE WHEN version_no = 2 THEN 'new-' || chunk_id ELSE chunk_id END) AS first_chunk
FROM children WHERE doc_id % 5 <> 0 GROUP BY version_id""",
    ),
    "delete_version_rows": S.sql(
        S.CHUNKS,
        select="""
SELECT version_id, count(*) AS n_rows,
       min(CASE WHEN version_no = 2 THEN 'new-' || chunk_id ELSE chunk_id END) AS first_chunk,
       CAST(sum(length(content)) AS BIGINT) AS n_chars
FROM children WHERE doc_id % 5 <> 0 GROUP BY version_id""",
    ),
    "insert_only_new": S.sql(
        """keyed AS (
  SELECT event_type || ':' || CAST(json_extract(props, '$.k') AS VARCHAR) AS event_key, event_id, user_id, event_type
  FROM events)""",
        select="""
SELECT event_key, event_id, user_id FROM keyed WHERE event_key NOT IN (
  SELECT event_key FROM keyed WHERE event_type = 'view')
QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY event_id) = 1""",
    ),
    "document_listing": S.sql(
        S.DIM, S.VERSIONS, JOBS,
        """last_job AS (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY created_at DESC, job_id DESC) = 1)""",
        select="""
SELECT d.doc_id, d.kb_id, d.title, d.status, d.active_version_id, j.job_id, j.status AS job_status
FROM documents_dim d LEFT JOIN last_job j USING (doc_id) WHERE NOT d.deleted""",
    ),
    "embedding_fingerprints": S.sql(
        S.VERSIONS,
        select="""
SELECT sha256('openai|' || CASE WHEN version_no = 1 THEN 'embed-a' WHEN doc_id % 2 = 0 THEN 'embed-b' ELSE '' END
       || '|1536') AS fingerprint, count(*) AS n_versions
FROM version_texts GROUP BY 1""",
    ),
}
