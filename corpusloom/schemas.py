"""Declared schemas: the given tables and the tables the jobs read and write."""

from __future__ import annotations

GIVEN = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "conversations": "conv_id long, turn long, role string, text string",
    "events": (
        "event_id long, ts timestamp_ntz, user_id long, event_type string, "
        "value double, props string"
    ),
}

# The fifteen tables of the data model; ids are strings made from natural keys.
MODEL = {
    "workspaces": "workspace_id string, name string",
    "knowledge_bases": (
        "kb_id string, workspace_id string, name string, description string, enabled boolean, "
        "chunking_config string, retrieval_config string"
    ),
    "documents_dim": (
        "doc_id long, kb_id string, title string, filename string, mime_type string, "
        "status string, active_version_id string, deleted boolean"
    ),
    "document_versions": (
        "version_id string, doc_id long, version_no int, file_path string, sha256 string, "
        "file_size long, pipeline_version string, parser_fingerprint string, "
        "embedding_fingerprint string, status string, error_code string, ready_at timestamp_ntz"
    ),
    "chunks": (
        "chunk_id string, version_id string, parent_chunk_id string, ordinal int, kind string, "
        "content string, embedding_text string, heading_path array<string>, page_start int, "
        "page_end int, char_start int, char_end int, token_count int"
    ),
    "chunk_vectors": (
        "chunk_id string, version_id string, kb_id string, content string, "
        "dense_vector array<float>"
    ),
    "ingestion_jobs": (
        "job_id string, version_id string, status string, current_stage string, progress int, "
        "attempt_count int, max_attempts int, heartbeat_at timestamp_ntz, "
        "next_retry_at timestamp_ntz, error_code string, idempotency_key string, "
        "created_at timestamp_ntz, updated_at timestamp_ntz"
    ),
    "outbox_events": (
        "event_id string, event_key string, event_type string, aggregate_id string, "
        "payload string, status string, attempt_count int, available_at timestamp_ntz, "
        "published_at timestamp_ntz, last_error_reference string"
    ),
    "wiki_configs": (
        "kb_id string, enabled boolean, token_limit long, tokens_reserved long, "
        "tokens_charged long"
    ),
    "wiki_pages": (
        "page_id string, kb_id string, slug string, page_type string, title string, "
        "current_version_id string, deleted boolean"
    ),
    "wiki_aliases": "page_id string, alias string, normalized_alias string",
    "wiki_versions": (
        "page_version_id string, page_id string, version_no int, title string, content string, "
        "summary string, generation_metadata string, origin string, review_state string, "
        "base_published_version_id string"
    ),
    "wiki_claims": (
        "claim_id string, page_version_id string, claim_key string, text string, "
        "trust_state string, reason string, position int, claim_type string"
    ),
    "wiki_claim_sources": (
        "claim_id string, doc_id long, version_id string, chunk_id string, chunk_kind string, "
        "chunk_ordinal int, content_sha256 string, document_title string, "
        "heading_path array<string>, page_start int, page_end int"
    ),
    "wiki_jobs": (
        "job_id string, kb_id string, version_id string, status string, stage string, "
        "progress int, attempt_count int, max_attempts int, reserved_tokens long, "
        "payload string, idempotency_key string, heartbeat_at timestamp_ntz, "
        "next_retry_at timestamp_ntz, error_code string"
    ),
    "wiki_token_usage": (
        "call_key string, kb_id string, job_id string, model string, reserved_tokens long, "
        "measured_tokens long, charged_tokens long"
    ),
}

# States, types and codes the operators honour.
DOCUMENT_STATES = ("pending", "processing", "ready", "failed", "deleting", "deleted")
VERSION_STATES = ("pending", "parsing", "chunking", "embedding", "indexing", "ready", "failed")
JOB_STATES = ("pending", "running", "retry_wait", "succeeded", "failed")
OUTBOX_STATES = ("pending", "processing", "published", "failed")
CLAIM_TYPES = ("summary_fact", "topic_fact", "source_excerpt", "manual")
TRUST_STATES = ("verified", "needs_review")
STAGE_PROGRESS = {"parsing": 10, "chunking": 30, "embedding": 50, "indexing": 75, "ready": 100}
EVENT_TYPES = (
    "document.ingestion.requested",
    "document.deletion.requested",
    "document.version.cleanup.requested",
    "knowledge_base.deletion.requested",
    "wiki.document.generate.requested",
)
