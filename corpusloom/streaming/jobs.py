"""Outbox and job-state rules as batch frames; the streaming jobs call the same functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.ordering import with_previous
from corpusloom.schemas import EVENT_TYPES

CLAIM_LIMIT = 100
LEASE_MINUTES = 2
STALE_MINUTES = 5
WIKI_STALE_MINUTES = 35
# Failures that a recovery does not repeat.
FINAL_FAILURES = ("document_parse_failed", "retry_exhausted")
# Handler of each event type.
ROUTES = {
    "document.ingestion.requested": "ingest",
    "document.deletion.requested": "delete_document",
    "document.version.cleanup.requested": "cleanup_version",
    "knowledge_base.deletion.requested": "delete_base",
    "wiki.document.generate.requested": "generate_wiki",
}


def claim_outbox(events: DataFrame, now: Column, limit: int = CLAIM_LIMIT) -> DataFrame:
    """The next events to publish: due, pending or with an expired lease, oldest first.

    They get the state processing, one more attempt and a lease.
    """
    due = events.where(F.col("status").isin("pending", "processing") & (F.col("available_at") <= now))
    taken = due.orderBy("available_at", "event_id").limit(limit)
    return taken.withColumns(
        {
            "status": F.lit("processing"),
            "attempt_count": F.col("attempt_count") + 1,
            "available_at": now + F.expr(f"INTERVAL {LEASE_MINUTES} MINUTES"),
        }
    )


def publish_outcomes(events: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Fold the newest publish outcome (event_id, attempt, published, reference) into each event.

    Published clears the error; a failure goes back to pending after its backoff.
    """
    last = outcomes.groupBy("event_id").agg(
        F.max_by(F.struct("published", "reference"), "attempt").alias("o"),
    )
    joined = events.join(last, "event_id", "left")
    published = F.col("o.published")
    delay = T.outbox_backoff(F.col("attempt_count"))
    later = now + F.make_dt_interval(secs=delay.cast("decimal(18,6)"))
    return joined.withColumns(
        {
            "status": F.when(published, "published").when(~published, "pending").otherwise(F.col("status")),
            "available_at": F.when(~published, later).otherwise(F.col("available_at")),
            "last_error_reference": F.when(~published, F.col("o.reference")),
            "delay_seconds": F.when(~published, delay),
        }
    ).drop("o")


def route(event_type: Column) -> Column:
    """Handler of an event; an unknown type goes to the dead letters."""
    target = F.lit("dead_letter")
    for name in EVENT_TYPES:
        target = F.when(event_type == name, ROUTES[name]).otherwise(target)
    return target


def recover_stale_jobs(
    jobs: DataFrame,
    versions: DataFrame,
    documents: DataFrame,
    published: DataFrame,
    stale_before: Column,
    limit: int = CLAIM_LIMIT,
) -> DataFrame:
    """Jobs whose heartbeat stopped, or that were published but never taken up, and what follows.

    `published` holds (job_id) of published ingestion events. Comparison with a null error code is
    unknown, so failed jobs without a code are left alone. An already active version makes the job
    succeed; exhausted attempts fail job and version and put the document back; any other job waits
    for a new delivery.
    """
    seen = published.select("job_id").distinct().withColumn("published", F.lit(True))
    state = (
        jobs.join(versions.select("version_id", "doc_id", "version_status"), "version_id")
        .join(
            documents.select("doc_id", F.col("status").alias("document_status"), "active_version_id"), "doc_id"
        )
        .join(seen, "job_id", "left")
        .withColumn("published", F.coalesce("published", F.lit(False)))
    )
    status, beat = F.col("status"), F.col("heartbeat_at")
    untouched = F.col("updated_at") < stale_before
    unconsumed = (
        status.isin("pending", "retry_wait")
        & untouched
        & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") < stale_before))
        & F.col("published")
    )
    failed = (status == "failed") & ~F.col("error_code").isin(*FINAL_FAILURES)
    silent = (beat < stale_before) | (beat.isNull() & untouched & F.col("published"))
    stale = state.where(
        ((status == "running") | failed | unconsumed)
        & silent
        & ~F.col("document_status").isin("deleting", "deleted")
    )
    picked = stale.orderBy(F.asc_nulls_last("heartbeat_at"), "job_id").limit(limit)
    active = F.coalesce(
        (F.col("active_version_id") == F.col("version_id")) & (F.col("version_status") == "ready"), F.lit(False)
    )
    attempts = F.col("attempt_count") + 1
    outcome = (
        F.when(active, "job_already_activated")
        .when(attempts >= F.col("max_attempts"), "job_retry_exhausted")
        .otherwise("job_requeued")
    )
    restored = F.when(F.col("active_version_id").isNotNull(), "ready").otherwise("failed")
    exhausted = outcome == "job_retry_exhausted"
    return picked.withColumns(
        {
            "outcome": outcome,
            "new_status": F.when(active, "succeeded").when(exhausted, "failed").otherwise("retry_wait"),
            "new_attempts": F.when(active, F.col("attempt_count")).otherwise(attempts),
            "new_document_status": F.when(exhausted, restored).otherwise(F.col("document_status")),
            "event_key": F.when(
                outcome == "job_requeued",
                F.concat_ws(":", F.lit("recover"), F.col("job_id").cast("string"), attempts.cast("string")),
            ),
        }
    )


def recover_stale_wiki_jobs(jobs: DataFrame, now: Column, limit: int = CLAIM_LIMIT) -> DataFrame:
    """Running wiki jobs without a heartbeat for 35 minutes, longest silence first."""
    silent = F.col("heartbeat_at") < now - F.expr(f"INTERVAL {WIKI_STALE_MINUTES} MINUTES")
    return jobs.where((F.col("status") == "running") & silent).orderBy("heartbeat_at", "job_id").limit(limit)


def wiki_failures(jobs: DataFrame) -> DataFrame:
    """State after failed generations: retry with backoff until the attempts are used up."""
    final = F.col("attempt_count") >= F.col("max_attempts")
    key = F.concat_ws(":", F.lit("wiki-retry"), F.col("job_id").cast("string"), F.col("attempt_count").cast("string"))
    return jobs.withColumns(
        {
            "new_status": F.when(final, "failed").otherwise("retry_wait"),
            "delay_seconds": F.when(~final, T.wiki_backoff(F.col("attempt_count"))),
            "event_key": F.when(~final, key),
        }
    )


def durable_retries(failures: DataFrame, jobs: DataFrame) -> DataFrame:
    """One delayed event per failure (job_id, retries), none for jobs that are done or waiting.

    Several failures of a job in one batch count once: the job waits after the first.
    """
    once = failures.groupBy("job_id").agg(F.min("retries").alias("retries"))
    joined = once.join(jobs.select("job_id", "status", "attempt_count", "max_attempts"), "job_id", "left")
    decision = (
        F.when(F.col("status").isNull(), "ingestion_job_not_found")
        .when(F.col("status").isin("succeeded", "retry_wait"), "already_settled")
        .when(F.col("attempt_count") >= F.col("max_attempts"), "retry_exhausted")
        .otherwise("scheduled")
    )
    scheduled = decision == "scheduled"
    attempts = F.col("attempt_count") + 1
    return joined.select(
        "job_id",
        decision.alias("decision"),
        F.when(scheduled, T.ingest_backoff(F.col("retries"))).alias("delay_seconds"),
        F.when(
            scheduled,
            F.concat_ws(":", F.lit("retry-job"), F.col("job_id").cast("string"), attempts.cast("string")),
        ).alias("event_key"),
    )


def progress_tail(
    jobs: DataFrame, versions: DataFrame, documents: DataFrame, bases: DataFrame, after: Column
) -> DataFrame:
    """Progress events of jobs changed after the cursor, a struct of (updated_at, job_id), in order."""
    owned = (
        jobs.where(F.struct("updated_at", "job_id") > after)
        .join(versions.select("version_id", "doc_id"), "version_id")
        .join(documents.select("doc_id", "kb_id"), "doc_id")
        .join(bases.select("kb_id"), "kb_id", "left_semi")
    )
    return owned.select(
        F.lit("document_progress").alias("type"), "doc_id", "job_id", "status", "error_code", "updated_at"
    ).orderBy("updated_at", "job_id")


def lifecycle_steps(log: DataFrame) -> DataFrame:
    """Steps of each job's event log (job_id, ts, event_id, status) with the seconds until the next."""
    steps = with_previous(log, ["job_id"], ["ts", "event_id"], ["ts"], offset=-1)
    seconds = F.timestamp_diff("SECOND", F.col("ts"), F.col("previous_ts"))
    return steps.withColumn("seconds", seconds).drop("previous_ts")


def lifecycle_summary(log: DataFrame) -> DataFrame:
    """Current status, attempts and span of each job; map-side aggregates only."""
    return log.groupBy("job_id").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"),
        F.count_if(F.col("status") == "running").alias("attempts"),
        F.count(F.lit(1)).alias("n_events"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def time_in_status(log: DataFrame) -> DataFrame:
    """Seconds every job spent in each status, the open last step left out."""
    return (
        lifecycle_steps(log)
        .groupBy("job_id", "status")
        .agg(F.count(F.lit(1)).alias("n_steps"), F.coalesce(F.sum("seconds"), F.lit(0)).cast("long").alias("seconds"))
    )


def registered_sources(found: DataFrame, limit: int = 8) -> DataFrame:
    """Citation ids of a turn's sources: at most eight distinct chunks in first-seen order.

    `found` is (turn_id, call_no, place, chunk_id). A call stops at its first chunk beyond the
    limit; repeats keep their id. First sightings are map-side minima, so a turn with very many
    sources is no hot group.
    """
    from corpusloom.operators.ordering import top_k

    first = found.groupBy("turn_id", "chunk_id").agg(F.min(F.struct("call_no", "place")).alias("seen"))
    kept = top_k(first, ["turn_id"], ["seen", "chunk_id"], limit, into="number").drop("seen")
    numbered = found.join(kept, ["turn_id", "chunk_id"], "left")
    stop = numbered.where("number IS NULL").groupBy("turn_id", "call_no").agg(F.min("place").alias("stop"))
    return (
        numbered.where("number IS NOT NULL")
        .join(stop, ["turn_id", "call_no"], "left")
        .where(F.col("stop").isNull() | (F.col("place") < F.col("stop")))
        .withColumn("citation_id", F.format_string("[%d]", "number"))
        .drop("stop")
    )


def turn_events(items: DataFrame) -> DataFrame:
    """Client events of model items (turn_id, seq, tool_call, content, n_sources) in order.

    New sources come first, then `retrieving` at the first tool call, `generating` before the first
    text, the text, and `done` at the end. Sources are published once per growth.
    """
    told = with_previous(items, ["turn_id"], ["seq"], ["n_sources"])
    marks = items.groupBy("turn_id").agg(
        F.min(F.when(F.col("tool_call"), F.col("seq"))).alias("first_call"),
        F.min(F.when(F.col("content") != "", F.col("seq"))).alias("first_text"),
        F.max("seq").alias("last"),
    )
    rows = told.join(marks, "turn_id")
    grown = F.col("n_sources") > F.coalesce("previous_n_sources", F.lit(0))

    def event(part: int, kind: str, detail: Column, when: Column) -> Column:
        body = F.struct(F.lit(part).alias("part"), F.lit(kind).alias("event"), detail.alias("detail"))
        return F.when(when, body)

    events = F.array_compact(
        F.array(
            event(0, "sources", F.col("n_sources").cast("string"), grown),
            event(1, "status", F.lit("retrieving"), F.col("seq") == F.col("first_call")),
            event(2, "status", F.lit("generating"), F.col("seq") == F.col("first_text")),
            event(3, "message", F.col("content"), F.col("content") != ""),
            event(4, "done", F.lit(""), F.col("seq") == F.col("last")),
        )
    )
    return rows.select("turn_id", "seq", F.inline(events))
