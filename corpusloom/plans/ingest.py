"""Version building and version state: uploads, activation, failure, actions, deletion, cleanup.

The plans take request and state tables and return decision columns or rows to append. Text never
takes part in a shuffle: state is joined on ids and digests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import chunking
from corpusloom.plugins import embed_children
from corpusloom.schemas import STAGE_PROGRESS

IN_FLIGHT_JOB = ("pending", "running", "retry_wait")
DELETING = ("deleting", "deleted")


def base_counts(bases: DataFrame, documents: DataFrame) -> DataFrame:
    """Live documents per base and how many of them are in work; empty bases are kept."""
    live = documents.where(~F.col("deleted")).groupBy("kb_id").agg(
        F.count(F.lit(1)).alias("document_count"),
        F.count_if(F.col("status").isin("pending", "processing")).alias("processing_count"),
    )
    zero = F.lit(0).cast("long")
    return bases.join(live, "kb_id", "left").withColumns(
        {
            "document_count": F.coalesce("document_count", zero),
            "processing_count": F.coalesce("processing_count", zero),
        }
    )


def duplicate_report(versions: DataFrame) -> DataFrame:
    """Groups of equal content inside a base, with the least document as keeper."""
    return (
        versions.groupBy("kb_id", "sha256")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("keeper"))
        .where("copies > 1")
    )


def base_requests(requests: DataFrame, bases: DataFrame) -> DataFrame:
    """Create or rename bases: the trimmed name must be free, first request of a name wins.

    `requests` is (request_id, action, kb_id, name); `bases` is (kb_id, name).
    """
    from corpusloom.functions.text import strip

    asked = requests.withColumn("name", strip(F.col("name")))
    known = bases.select(F.col("kb_id").alias("known_id")).distinct()
    taken = bases.groupBy("name").agg(F.min("kb_id").alias("owner"))
    joined = asked.join(taken, "name", "left").join(known, F.col("kb_id") == F.col("known_id"), "left")
    rename = F.col("action") == "rename"
    missing = rename & F.col("known_id").isNull()
    free = F.col("owner").isNull() | (rename & (F.col("owner") == F.col("kb_id")))
    open_requests = joined.where(~missing & free)
    first = open_requests.groupBy("name").agg(F.min("request_id").alias("winner"))
    decided = joined.join(first, "name", "left")
    return decided.select(
        "request_id",
        "action",
        "name",
        F.when(missing, "knowledge_base_not_found")
        .when(~free | (F.col("winner") != F.col("request_id")), "knowledge_base_name_conflict")
        .otherwise("ok")
        .alias("decision"),
    )


def plan_uploads(
    uploads: DataFrame, bases: DataFrame, documents: DataFrame, versions: DataFrame
) -> DataFrame:
    """Decide accepted uploads: new_document, new_version, duplicate_document, base not found.

    Uploads are taken in `upload_id` order. An upload duplicates a version of the same base and
    digest that is active or still in work. With `on_duplicate = new_version` a duplicate of an
    active version becomes its next version; the version then in work turns later copies away. So
    per (base, digest) at most one upload is accepted, and which one follows from two minima that
    are computed map-side, however many copies a digest has.
    """
    live = documents.where(~F.col("deleted")).select("doc_id", "kb_id", "active_version_id")
    held = versions.select("doc_id", "version_id", "version_no", "sha256", "version_status")
    matching = held.join(live, "doc_id").where(
        (F.col("active_version_id") == F.col("version_id"))
        | ~F.col("version_status").isin("failed", "ready")
    )
    newest = matching.groupBy("kb_id", "sha256").agg(
        F.max_by(
            F.struct(
                "doc_id",
                F.coalesce(F.col("active_version_id") == F.col("version_id"), F.lit(False)).alias("active"),
            ),
            F.struct("version_no", -F.col("doc_id")),
        ).alias("held")
    )
    highest = versions.groupBy("doc_id").agg(F.max("version_no").alias("highest"))
    held_rows = newest.select(
        "kb_id", "sha256", F.col("held.doc_id").alias("doc_id"), F.col("held.active").alias("held_active")
    ).join(highest, "doc_id")
    known = uploads.join(bases.select("kb_id"), "kb_id", "left_semi")
    first = known.groupBy("kb_id", "sha256").agg(
        F.min("upload_id").alias("first_any"),
        F.min(F.when(F.col("on_duplicate") == "new_version", F.col("upload_id"))).alias("first_new"),
    )
    accepted = first.join(held_rows, ["kb_id", "sha256"], "left").select(
        "kb_id",
        "sha256",
        F.when(F.col("doc_id").isNull(), F.col("first_any"))
        .when(F.col("held_active"), F.col("first_new"))
        .alias("accepted_id"),
        "doc_id",
        "highest",
    )
    joined = uploads.join(accepted, ["kb_id", "sha256"], "left")
    missing = F.col("first_seen").isNull()
    joined = joined.join(bases.select("kb_id", F.lit(1).alias("first_seen")), "kb_id", "left")
    taken = F.coalesce(F.col("accepted_id") == F.col("upload_id"), F.lit(False))
    decision = (
        F.when(missing, "knowledge_base_not_found")
        .when(~taken, "duplicate_document")
        .when(F.col("doc_id").isNull(), "new_document")
        .otherwise("new_version")
    )
    number = F.when(decision == "new_document", F.lit(1)).when(
        decision == "new_version", F.col("highest") + 1
    )
    target = F.when(decision == "new_document", F.concat(F.lit("upload-"), F.col("upload_id"))).when(
        decision == "new_version", F.col("doc_id").cast("string")
    )
    return joined.withColumns(
        {"decision": decision, "version_no": number, "document_key": target}
    ).drop("accepted_id", "doc_id", "highest", "first_seen")


def upload_rows(planned: DataFrame) -> dict[str, DataFrame]:
    """The version, job and outbox rows that accepted uploads add."""
    accepted = planned.where(F.col("decision").isin("new_document", "new_version")).withColumn(
        "version_id", F.concat_ws("-v", "document_key", F.col("version_no").cast("string"))
    )
    key = F.concat(F.lit("ingest:"), F.col("version_id"))
    job = F.concat(F.lit("job:"), F.col("version_id"))
    pending = F.lit("pending").alias("status")
    return {
        "versions": accepted.select("version_id", "document_key", "version_no", "sha256", pending),
        "jobs": accepted.select(
            job.alias("job_id"), "version_id", pending, key.alias("idempotency_key")
        ),
        "events": accepted.select(
            key.alias("event_key"),
            F.lit("document.ingestion.requested").alias("event_type"),
            F.col("version_id").alias("aggregate_id"),
            F.to_json(F.struct(job.alias("job_id"), F.col("version_id").alias("document_version_id"))).alias(
                "payload"
            ),
        ),
    }


def build_versions(
    versions: DataFrame,
    embedder: Callable[[Column], Column],
    dimension: int,
    child_characters: int = chunking.CHILD_CHARACTERS,
) -> dict[str, DataFrame]:
    """Chunk, embed and verify versions (version_id, sections, ...).

    `outcomes` compares the children each version must have, known from its sections alone, with
    those that got a vector: only complete versions become ready.
    """
    chunks = chunking.with_chunk_ids(chunking.chunk_rows(versions, child_characters=child_characters))
    children = chunks.where(F.col("kind") == "child")
    embedded = embed_children(children, embedder, dimension)
    index = embedded.where("vector_ok")
    outcomes = version_outcomes(versions, index, child_characters)
    return {"chunks": chunks, "index": index, "outcomes": outcomes}


def version_outcomes(
    versions: DataFrame, index: DataFrame, child_characters: int = chunking.CHILD_CHARACTERS
) -> DataFrame:
    """Per version: children wanted by its sections, children in `index`, status and error code."""
    expected = F.aggregate(
        F.transform("sections", lambda s: F.ceil(F.length(s["text"]) / child_characters)),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    wanted = versions.select("version_id", expected.alias("expected_children"))
    indexed = index.groupBy("version_id").agg(F.count(F.lit(1)).alias("indexed_children"))
    counted = wanted.join(indexed, "version_id", "left").withColumn(
        "indexed_children", F.coalesce("indexed_children", F.lit(0).cast("long"))
    )
    code = (
        F.when(F.col("expected_children") == 0, "document_parse_failed")
        .when(F.col("expected_children") != F.col("indexed_children"), "index_verification_failed")
    )
    return counted.withColumn("error_code", code).withColumn(
        "status", F.when(F.col("error_code").isNull(), "ready").otherwise("failed")
    )


def stage_rows(outcomes: DataFrame) -> DataFrame:
    """Progress rows per version: every stage reached, with its percentage."""
    stages = list(STAGE_PROGRESS.items())

    def rows(names: list[tuple[str, int]]) -> Column:
        return F.array(*(F.struct(F.lit(n).alias("stage"), F.lit(p).alias("progress")) for n, p in names))

    reached = (
        F.when(F.col("error_code") == "document_parse_failed", rows(stages[:1]))
        .when(F.col("error_code").isNotNull(), rows(stages[:4]))
        .otherwise(rows(stages))
    )
    return outcomes.select("version_id", F.inline(reached))


def index_completeness(expected: DataFrame, indexed: DataFrame) -> DataFrame:
    """Per version: children expected and indexed, and whether the version may be activated."""
    left = expected.groupBy("version_id").agg(F.count(F.lit(1)).alias("expected"))
    right = indexed.groupBy("version_id").agg(F.count(F.lit(1)).alias("indexed"))
    zero = F.lit(0).cast("long")
    both = left.join(right, "version_id", "full_outer").select(
        "version_id",
        F.coalesce("expected", zero).alias("expected"),
        F.coalesce("indexed", zero).alias("indexed"),
    )
    return both.withColumn(
        "outcome",
        F.when(F.col("expected") == F.col("indexed"), "activated").otherwise("index_verification_failed"),
    )


def activate(proposals: DataFrame, documents: DataFrame, configs: DataFrame) -> DataFrame:
    """Compare-and-set of active versions, with the follow-up work of each activation.

    `proposals` is (doc_id, version_id, previous_version_id, verified).
    """
    state = documents.select("doc_id", "kb_id", "status", "active_version_id")
    enabled = configs.where("enabled").select("kb_id", F.lit(True).alias("wiki_on"))
    joined = proposals.join(state, "doc_id", "left").join(enabled, "kb_id", "left")
    previous = F.col("previous_version_id")
    outcome = (
        F.when(F.col("status").isNull(), "document_version_not_found")
        .when(~F.col("verified"), "index_verification_failed")
        .when(F.col("status").isin(*DELETING), "ingestion_document_deleting")
        .when(~F.col("active_version_id").eqNullSafe(previous), "active_version_changed")
        .otherwise("activated")
    )
    done = F.col("outcome") == "activated"
    replaced = done & previous.isNotNull() & (previous != F.col("version_id"))
    return (
        joined.withColumn("outcome", outcome)
        .withColumn("invalidate_claims", replaced)
        .withColumn("cleanup_key", F.when(replaced, F.concat(F.lit("cleanup-version:"), previous)))
        .withColumn(
            "wiki_key",
            F.when(
                done & F.coalesce("wiki_on", F.lit(False)),
                F.concat(F.lit("wiki:"), F.col("version_id"), F.lit(":wiki-v1")),
            ),
        )
        .drop("wiki_on")
    )


def failure_outcomes(failures: DataFrame, documents: DataFrame) -> DataFrame:
    """State after failed versions (doc_id, version_id, code): a document with an active version
    stays ready, one being deleted keeps its state, any other fails."""
    state = documents.select("doc_id", "status", "active_version_id")
    keep = F.col("status").isin(*DELETING)
    after = (
        F.when(keep, F.col("status"))
        .when(F.col("active_version_id").isNotNull(), "ready")
        .otherwise("failed")
    )
    return failures.join(state, "doc_id", "left").select(
        "doc_id",
        "version_id",
        F.lit("failed").alias("version_status"),
        F.col("code").alias("error_code"),
        after.alias("document_status"),
        F.concat(F.lit("failed-version:"), F.col("version_id")).alias("cleanup_key"),
    )


def latest_versions(versions: DataFrame) -> DataFrame:
    """Newest version of each document and the next free number, by a map-side maximum."""
    newest = versions.groupBy("doc_id").agg(
        F.max_by(F.struct("version_id", "version_status"), "version_no").alias("v"),
        F.max("version_no").alias("version_no"),
    )
    return newest.select(
        "doc_id",
        F.col("v.version_id").alias("version_id"),
        F.col("v.version_status").alias("version_status"),
        "version_no",
        (F.col("version_no") + 1).alias("next_version_no"),
    )


def latest_jobs(jobs: DataFrame, key: str = "version_id") -> DataFrame:
    """Newest job per key by creation time, then id."""
    rest = [c for c in jobs.columns if c != key]
    newest = jobs.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("created_at", "job_id")).alias("j"))
    return newest.select(key, *(F.col(f"j.{c}").alias(c) for c in rest))


def plan_actions(
    requests: DataFrame, documents: DataFrame, versions: DataFrame, jobs: DataFrame
) -> DataFrame:
    """Decide retry and reindex requests (request_id, doc_id, action), one per document.

    A request of the same kind already in work is reused. `version_no` is the version the new job
    works on: the failed one for a retry, the next one for a reindex, which takes over the current
    embedding configuration.
    """
    live = documents.where(~F.col("deleted")).select("doc_id", "status", "active_version_id")
    newest = latest_versions(versions).select("doc_id", "version_id", "version_status", "version_no")
    last = latest_jobs(jobs).select(
        "version_id", "job_id", F.col("status").alias("job_status"), "idempotency_key"
    )
    joined = (
        requests.join(live, "doc_id", "left").join(newest, "doc_id", "left").join(last, "version_id", "left")
    )
    same = F.startswith("idempotency_key", F.concat("action", F.lit(":"))) & F.col("job_status").isin(
        *IN_FLIGHT_JOB
    )
    retryable = (F.col("version_status") == "failed") & (F.col("job_status") == "failed")
    decision = (
        F.when(~F.col("action").isin("retry", "reindex"), "unsupported_document_action")
        .when(F.col("status").isNull(), "document_not_found")
        .when(F.col("status").isin(*DELETING), "document_deleting")
        .when(F.col("version_id").isNull(), "document_has_no_version")
        .when(F.coalesce(same, F.lit(False)), "reused")
        .when((F.col("action") == "retry") & ~F.coalesce(retryable, F.lit(False)), "document_not_failed")
        .when((F.col("action") == "reindex") & F.col("active_version_id").isNull(), "document_not_ready")
        .otherwise("scheduled")
    )
    number = F.when(
        decision == "scheduled",
        F.when(F.col("action") == "reindex", F.col("version_no") + 1).otherwise(F.col("version_no")),
    )
    return joined.select(
        "request_id",
        "doc_id",
        "action",
        decision.alias("decision"),
        number.alias("work_version_no"),
        F.when(decision == "reused", F.col("job_id")).alias("reused_job_id"),
    )


def plan_document_deletion(requests: DataFrame, documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Idempotent deletion: one `delete:` job per document, a repeated request gets that job."""
    live = documents.where(~F.col("deleted")).select("doc_id", F.lit(True).alias("live"))
    key = F.concat(F.lit("delete:"), F.col("doc_id").cast("string"))
    existing = jobs.select(F.col("idempotency_key").alias("delete_key"), F.col("job_id").alias("existing_job"))
    first = requests.groupBy("doc_id").agg(F.min("request_id").alias("winner"))
    joined = (
        requests.join(first, "doc_id")
        .join(live, "doc_id", "left")
        .withColumn("delete_key", key)
        .join(existing, "delete_key", "left")
    )
    return joined.select(
        "request_id",
        "doc_id",
        F.when(F.col("live").isNull(), "document_not_found")
        .when(F.col("existing_job").isNotNull() | (F.col("winner") != F.col("request_id")), "already_deleting")
        .otherwise("deleting")
        .alias("decision"),
        "delete_key",
    )


def plan_base_deletion(requests: DataFrame, bases: DataFrame, documents: DataFrame) -> DataFrame:
    """Base deletion: an empty base goes at once, a filled one needs confirmation."""
    counts = base_counts(bases.select("kb_id"), documents).select("kb_id", "document_count")
    joined = requests.join(counts, "kb_id", "left")
    filled = F.col("document_count") > 0
    return joined.select(
        "request_id",
        "kb_id",
        F.when(F.col("document_count").isNull(), "knowledge_base_not_found")
        .when(filled & ~F.col("confirm"), "knowledge_base_not_empty")
        .when(filled, "deleting")
        .otherwise("deleted")
        .alias("decision"),
        F.when(filled & F.col("confirm"), F.concat(F.lit("delete-kb:"), F.col("kb_id"))).alias("event_key"),
    )


def cleanup_selection(requests: DataFrame, versions: DataFrame, documents: DataFrame) -> DataFrame:
    """Versions whose index may be removed: not active, and ready or failed."""
    state = documents.select("doc_id", "active_version_id")
    joined = (
        requests.join(versions.select("version_id", "doc_id", "version_status"), "version_id", "left")
        .join(state, "doc_id", "left")
    )
    active = F.coalesce(F.col("active_version_id") == F.col("version_id"), F.lit(False))
    return joined.select(
        "version_id",
        F.when(F.col("doc_id").isNull(), "version_not_found")
        .when(active, "kept_active")
        .when(~F.col("version_status").isin("ready", "failed"), "kept_in_work")
        .otherwise("remove_index")
        .alias("decision"),
    )


def orphan_files(versions: DataFrame, gone_documents: DataFrame) -> DataFrame:
    """Distinct stored files of deleted documents; a file kept by a reindexed version counts once."""
    return versions.join(gone_documents.select("doc_id"), "doc_id", "left_semi").select("file_path").distinct()


def document_listing(documents: DataFrame, versions: DataFrame, jobs: DataFrame) -> DataFrame:
    """Live documents with their newest job, null where there is none."""
    owned = jobs.join(versions.select("version_id", "doc_id"), "version_id")
    last = latest_jobs(owned.drop("version_id"), "doc_id").select(
        "doc_id", "job_id", F.col("status").alias("job_status")
    )
    return documents.where(~F.col("deleted")).join(last, "doc_id", "left")
