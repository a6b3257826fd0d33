"""Registered event, job and stream queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.catalog import sql as S
from corpusloom.catalog.texts import FILTERED, MESSAGES, marked_messages
from corpusloom.functions import text as T
from corpusloom.plugins import hash_embedder
from corpusloom.sources import tables
from corpusloom.streaming import jobs as J
from corpusloom.streaming import streams

STATUS = {"signup": "pending", "click": "running", "view": "heartbeat", "purchase": "succeeded", "error": "failed"}
EVENT_TYPE = {
    "signup": "document.ingestion.requested",
    "purchase": "document.deletion.requested",
    "view": "document.version.cleanup.requested",
    "click": "wiki.document.generate.requested",
    "error": "unknown.event",
}


def mapped(values: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, value in values.items():
        out = F.when(F.col("event_type") == key, value).otherwise(out)
    return out


def now() -> Column:
    return F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")


def k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def outbox(spark: SparkSession, folder: str) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "published").when(
        F.col("event_type") == "error", "failed"
    ).when(F.col("event_type") == "click", "processing").otherwise("pending")
    return tables.read(spark, folder, "events").select(
        "event_id", status.alias("status"), F.col("ts").alias("available_at"),
        (k() % 10).alias("attempt_count"), F.lit(None).cast("string").alias("last_error_reference"),
    )


def outbox_claim(spark: SparkSession, folder: str) -> DataFrame:
    rows = J.claim_outbox(outbox(spark, folder), now())
    return rows.select(
        "event_id", "status", F.col("attempt_count").cast("long").alias("attempt_count"),
        T.micros(F.col("available_at")).alias("available_us"),
    )


def outbox_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Publish attempts of waiting events, several per event; the newest one counts."""
    events = outbox(spark, folder)
    attempts = events.where("status IN ('pending', 'processing') AND event_id % 3 <> 0").select(
        "event_id", F.explode(F.sequence(F.lit(1), (F.col("event_id") % 4 + 1).cast("int"))).alias("attempt")
    )
    outcomes = attempts.select(
        "event_id",
        "attempt",
        ((F.col("event_id") + F.col("attempt")) % 2 == 0).alias("published"),
        F.concat_ws("-", F.lit("outbox"), "event_id", "attempt").alias("reference"),
    )
    rows = J.publish_outcomes(events, outcomes, now())
    return rows.select(
        "event_id", "status", "last_error_reference", "delay_seconds", T.micros(F.col("available_at")).alias("available_us")
    )


def job_log(spark: SparkSession, folder: str) -> DataFrame:
    return tables.read(spark, folder, "events").select(
        F.col("user_id").alias("job_id"), "ts", "event_id", mapped(STATUS).alias("status")
    )


def job_state(spark: SparkSession, folder: str) -> DataFrame:
    """Current state of the ingestion jobs as their events left it."""
    user = F.col("user_id")
    events = tables.read(spark, folder, "events")
    folded = events.groupBy("user_id").agg(
        F.max_by(mapped(STATUS), F.when(F.col("event_type") != "view", F.struct("ts", "event_id"))).alias("status"),
        F.max(F.when(F.col("event_type").isin("click", "view"), F.col("ts"))).alias("beat"),
        F.max("ts").alias("updated_at"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
    )
    status = F.when(user % 7 == 0, "retry_wait").otherwise(F.col("status"))
    return folded.select(
        user.alias("job_id"),
        F.concat(user.cast("string"), F.lit("-v1")).alias("version_id"),
        status.alias("status"),
        F.when(user % 3 != 0, F.col("beat")).alias("heartbeat_at"),
        "updated_at",
        F.lit(None).cast("timestamp_ntz").alias("next_retry_at"),
        F.when(status == "failed", F.when(user % 4 == 1, "document_parse_failed").when(user % 4 != 0, "ingestion_failed")).alias("error_code"),
        (F.col("errors") % 4).cast("int").alias("attempt_count"),
        F.lit(3).alias("max_attempts"),
    )


def stale_limit() -> Column:
    return F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")


def stale_recovery(spark: SparkSession, folder: str) -> DataFrame:
    published = tables.read(spark, folder, "events").where((F.col("event_type") == "purchase") & (k() % 2 == 0)).select(
        F.to_json(F.struct(F.col("user_id").alias("job_id"))).alias("payload")
    ).select(F.get_json_object("payload", "$.job_id").cast("long").alias("job_id"))
    documents = tables.documents_dim(spark, folder).withColumn(
        "status", F.when(F.col("deleted"), "deleting").otherwise(F.col("status"))
    )
    rows = J.recover_stale_jobs(
        job_state(spark, folder), tables.version_texts(spark, folder).drop("text"), documents, published, stale_limit()
    )
    return rows.select(
        "job_id", "status", "outcome", "new_status", F.col("new_attempts").cast("long").alias("new_attempts"),
        "new_document_status", "event_key",
    )


def wiki_stale_recovery(spark: SparkSession, folder: str) -> DataFrame:
    rows = J.recover_stale_wiki_jobs(job_state(spark, folder), stale_limit())
    return rows.select("job_id", T.micros(F.col("heartbeat_at")).alias("heartbeat_us"))


def wiki_failure_retry(spark: SparkSession, folder: str) -> DataFrame:
    failed = job_state(spark, folder).where("status IN ('failed', 'running')")
    rows = J.wiki_failures(failed.withColumn("attempt_count", F.col("attempt_count") + 1))
    return rows.select("job_id", "new_status", "delay_seconds", "event_key")


def durable_retry(spark: SparkSession, folder: str) -> DataFrame:
    failures = tables.read(spark, folder, "events").where("event_type = 'error'").select(
        (F.col("user_id") + F.when(k() == 7, 100_000).otherwise(0)).alias("job_id"), (k() % 9).alias("retries")
    )
    return J.durable_retries(failures, job_state(spark, folder))


def progress_tail(spark: SparkSession, folder: str) -> DataFrame:
    cursor = F.struct(F.expr("TIMESTAMP_NTZ '2024-01-29 12:00:00'").alias("updated_at"), F.lit(50).cast("long").alias("job_id"))
    rows = J.progress_tail(
        job_state(spark, folder),
        tables.version_texts(spark, folder).drop("text"),
        tables.documents_dim(spark, folder),
        tables.knowledge_bases(spark, folder),
        cursor,
    )
    return rows.select("type", "doc_id", "job_id", "status", "error_code", T.micros(F.col("updated_at")).alias("updated_us"))


def job_lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    rows = J.lifecycle_summary(job_log(spark, folder))
    return rows.select(
        "job_id", "status", "attempts", "n_events", T.micros(F.col("first_ts")).alias("first_us"),
        T.micros(F.col("last_ts")).alias("last_us"),
    )


def job_time_in_status(spark: SparkSession, folder: str) -> DataFrame:
    return J.time_in_status(job_log(spark, folder))


def turn_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Long words of a conversation's messages stand for the chunks its calls return."""
    words = F.filter(F.split("text", r"[ \n]+"), lambda w: F.length(w) >= 6)
    found = tables.read(spark, folder, "conversations").select(
        F.col("conv_id").alias("turn_id"), F.col("turn").alias("call_no"), F.posexplode(words).alias("place", "chunk_id")
    )
    rows = J.registered_sources(found)
    return rows.select(
        "turn_id", "call_no", F.col("place").cast("long").alias("place"), "chunk_id", "citation_id"
    )


def stream_event_order(spark: SparkSession, folder: str) -> DataFrame:
    items = tables.read(spark, folder, "conversations").select(
        F.col("conv_id").alias("turn_id"),
        F.col("turn").alias("seq"),
        (F.col("role") == "user").alias("tool_call"),
        F.when(F.col("role") == "assistant", F.col("text")).otherwise("").alias("content"),
        F.least(F.floor(F.col("turn") / 2), F.lit(8)).alias("n_sources"),
    )
    rows = J.turn_events(items)
    return rows.select("turn_id", "seq", F.col("part").cast("long").alias("part"), "event", "detail")


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a file stream of keyed outbox events."""
    raw = tables.read_stream(spark, folder, "events")
    key = F.concat_ws(":", "event_type", F.col("user_id").cast("string"), F.get_json_object("props", "$.k"))
    return raw.select(
        key.alias("event_key"), mapped(EVENT_TYPE).alias("event_type"), F.col("ts").cast("timestamp").alias("ts")
    )


def stream_dedup_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Consume the events as a stream, once per key, routed by type."""
    run = streams.run_folder(spark, "events")
    streams.consume_events(event_stream(spark, folder), run)
    return spark.read.parquet(f"{run}/events").select("event_key", "event_type", "route")


def stream_dedup_history(spark: SparkSession, folder: str) -> DataFrame:
    """Events sent in two halves and then all again: accepted and acknowledged per micro-batch."""
    run = streams.run_folder(spark, "history")
    key = F.concat_ws(":", "event_type", F.col("user_id").cast("string"), F.get_json_object("props", "$.k"))
    sent = tables.read(spark, folder, "events").select(
        "event_id", key.alias("event_key"), mapped(EVENT_TYPE).alias("event_type"), F.col("ts").cast("timestamp").alias("ts")
    )
    schema = sent.drop("event_id").schema
    for part in (F.col("event_id") % 2 == 0, F.col("event_id") % 2 == 1, F.lit(True)):
        sent.where(part).drop("event_id").write.mode("append").parquet(f"{run}/input")
        streams.consume_events(spark.readStream.schema(schema).parquet(f"{run}/input"), run)
    accepted = spark.read.parquet(f"{run}/events").groupBy("epoch").agg(F.count(F.lit(1)).alias("accepted"))
    repeats = spark.read.parquet(f"{run}/acknowledged")
    return repeats.join(accepted, "epoch", "left").select(
        F.col("epoch").cast("long").alias("epoch"), F.coalesce("accepted", F.lit(0).cast("long")).alias("accepted"), "acknowledged"
    )


def stream_incremental_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Build the documents of a file stream and report what became searchable."""
    run = streams.run_folder(spark, "ingest")
    raw = tables.read_stream(spark, folder, "documents")
    from corpusloom.operators.chunking import line_sections

    versions = raw.select(
        F.col("doc_id").cast("string").alias("version_id"),
        F.col("source").alias("kb_id"),
        line_sections(F.col("text"), F.array("source", "lang")).alias("sections"),
    )
    streams.ingest_versions(versions, run, hash_embedder(64), 64, tables.CHILD_CHARACTERS)
    index = spark.read.parquet(f"{run}/index")
    return index.groupBy("version_id").agg(
        F.count(F.lit(1)).alias("n_children"), F.sum(F.length("content")).alias("n_chars")
    )


def stream_job_lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    """Newest state of every job kept by a streaming aggregation."""
    run = streams.run_folder(spark, "jobs")
    raw = tables.read_stream(spark, folder, "events")
    log = raw.select(F.col("user_id").alias("job_id"), "ts", "event_id", mapped(STATUS).alias("status"))
    streams.follow_lifecycle(log, run)
    return streams.newest_states(spark, run)


def message_fragments(spark: SparkSession, folder: str) -> DataFrame:
    """Messages in fragments of seven characters, sent one second after another."""
    parts = F.regexp_extract_all("text", F.lit("(?s).{1,7}"), F.lit(0))
    fragments = marked_messages(spark, folder).select(
        "conv_id", F.concat_ws("-", "conv_id", "turn").alias("message_id"), parts.alias("parts")
    ).select(
        "conv_id", "message_id", F.posexplode("parts").alias("fragment_no", "fragment"), F.size("parts").alias("n")
    )
    return fragments.select(
        "conv_id",
        "message_id",
        F.col("fragment_no").cast("long").alias("fragment_no"),
        "fragment",
        (F.col("fragment_no") == F.col("n") - 1).alias("last"),
        F.timestamp_seconds(F.col("fragment_no") + 1_700_000_000).alias("sent_at"),
    )


def keyed_messages(messages: DataFrame) -> DataFrame:
    ids = F.split("message_id", "-")
    return messages.select(ids[0].cast("long").alias("conv_id"), ids[1].cast("long").alias("turn"), "text", "expired")


def stream_citation_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Messages arriving in fragments of seven characters, filtered with state per message."""
    run = streams.run_folder(spark, "citations")
    written = message_fragments(spark, folder).drop("conv_id")
    written.write.mode("overwrite").parquet(f"{run}/input")
    streams.filter_citations(spark.readStream.schema(written.schema).parquet(f"{run}/input"), run, delay="2 days")
    return keyed_messages(streams.whole_messages(spark, run)).drop("expired")


def stream_citation_lost(spark: SparkSession, folder: str) -> DataFrame:
    """Fragments over three batches: of a third of the conversations every fragment with an odd number comes a
    batch late, of another third the second fragment and the last one never come; those expire."""
    run = streams.run_folder(spark, "lost")
    sort, odd = F.col("conv_id") % 3, F.col("fragment_no") % 2 == 1
    sent = message_fragments(spark, folder).where(~((sort == 1) & (F.col("last") | (F.col("fragment_no") == 1))))
    # The whole third is sent five days later: it moves the watermark past the others.
    later = F.when(sort == 2, F.col("sent_at") + F.expr("INTERVAL 5 DAYS")).otherwise(F.col("sent_at"))
    sent = sent.withColumn("sent_at", later)
    schema = sent.drop("conv_id").schema
    for part in ((sort < 2) & ~((sort == 0) & odd), (sort == 0) & odd, sort == 2):
        sent.where(part).drop("conv_id").write.mode("append").parquet(f"{run}/input")
        streams.filter_citations(spark.readStream.schema(schema).parquet(f"{run}/input"), run, delay="2 days")
    return keyed_messages(streams.whole_messages(spark, run))


QUERIES = {
    "outbox_claim": outbox_claim,
    "outbox_outcomes": outbox_outcomes,
    "stale_recovery": stale_recovery,
    "wiki_stale_recovery": wiki_stale_recovery,
    "wiki_failure_retry": wiki_failure_retry,
    "durable_retry": durable_retry,
    "progress_tail": progress_tail,
    "job_lifecycle": job_lifecycle,
    "job_time_in_status": job_time_in_status,
    "turn_registry": turn_registry,
    "stream_event_order": stream_event_order,
    "stream_dedup_ingest": stream_dedup_ingest,
    "stream_incremental_ingest": stream_incremental_ingest,
    "stream_job_lifecycle": stream_job_lifecycle,
    "stream_citation_filter": stream_citation_filter,
    "stream_citation_lost": stream_citation_lost,
    "stream_dedup_history": stream_dedup_history,
}

STATUS_SQL = (
    "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'view' THEN 'heartbeat' "
    "WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END"
)
KEYED = f"""
ev AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k, {STATUS_SQL} AS status FROM events)"""
OUTBOX = """
outbox AS (
  SELECT event_id, CASE event_type WHEN 'purchase' THEN 'published' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'processing'
           ELSE 'pending' END AS status, ts AS available_at, k % 10 AS attempt_count FROM ev)"""
STATE = """
folded AS (
  SELECT user_id AS job_id, arg_max(status, ts) FILTER (event_type <> 'view') AS status,
         max(ts) FILTER (event_type IN ('click', 'view')) AS beat, max(ts) AS updated_at,
         count(*) FILTER (event_type = 'error') % 4 AS attempt_count
  FROM ev GROUP BY 1),
job_state AS (
  SELECT job_id, job_id || '-v1' AS version_id, updated_at, attempt_count,
         CASE WHEN job_id % 7 = 0 THEN 'retry_wait' ELSE status END AS status,
         CASE WHEN job_id % 3 <> 0 THEN beat END AS heartbeat_at,
         CASE WHEN job_id % 7 <> 0 AND status = 'failed' THEN CASE job_id % 4 WHEN 1 THEN 'document_parse_failed'
              WHEN 0 THEN NULL ELSE 'ingestion_failed' END END AS error_code
  FROM folded)"""

SQL = {
    "outbox_claim": S.sql(
        KEYED, OUTBOX,
        select="""
SELECT event_id, 'processing' AS status, attempt_count + 1 AS attempt_count,
       epoch_us(TIMESTAMP '2024-01-20 00:02:00') AS available_us
FROM (SELECT * FROM outbox WHERE status IN ('pending', 'processing') AND available_at <= TIMESTAMP '2024-01-20 00:00:00'
      ORDER BY available_at, event_id LIMIT 100)""",
    ),
    "outbox_outcomes": S.sql(
        KEYED, OUTBOX,
        """judged AS (
  SELECT *, CASE WHEN status IN ('pending', 'processing') AND event_id % 3 <> 0 THEN event_id % 4 + 1 END AS attempt FROM outbox),
told AS (SELECT *, (event_id + attempt) % 2 = 0 AS published, CAST(least(300, pow(2, least(attempt_count, 8))) AS BIGINT) AS delay
         FROM judged)""",
        select="""
SELECT event_id, CASE WHEN published THEN 'published' WHEN NOT published THEN 'pending' ELSE status END AS status,
       CASE WHEN NOT published THEN 'outbox-' || event_id || '-' || attempt END AS last_error_reference,
       CASE WHEN NOT published THEN delay END AS delay_seconds,
       CASE WHEN NOT published THEN epoch_us(TIMESTAMP '2024-01-20 00:00:00') + delay * 1000000
            ELSE epoch_us(available_at) END AS available_us
FROM told""",
    ),
    "stale_recovery": S.sql(
        S.DIM, S.VERSIONS, KEYED, STATE,
        """published AS (SELECT DISTINCT user_id AS job_id FROM ev WHERE event_type = 'purchase' AND k % 2 = 0),
joined AS (
  SELECT j.*, v.version_status, d.active_version_id, CASE WHEN d.deleted THEN 'deleting' ELSE d.status END AS document_status,
         p.job_id IS NOT NULL AS published
  FROM job_state j JOIN version_texts v USING (version_id) JOIN documents_dim d USING (doc_id)
       LEFT JOIN published p ON p.job_id = j.job_id),
stale AS (
  SELECT *, active_version_id = version_id AND version_status = 'ready' AS active FROM joined
  WHERE (status = 'running' OR (status = 'failed' AND error_code NOT IN ('document_parse_failed', 'retry_exhausted'))
         OR (status IN ('pending', 'retry_wait') AND updated_at < TIMESTAMP '2024-01-31' AND published))
    AND (heartbeat_at < TIMESTAMP '2024-01-31' OR (heartbeat_at IS NULL AND updated_at < TIMESTAMP '2024-01-31' AND published))
    AND document_status NOT IN ('deleting', 'deleted')
  ORDER BY heartbeat_at ASC NULLS LAST, job_id LIMIT 100),
decided AS (
  SELECT *, CASE WHEN coalesce(active, false) THEN 'job_already_activated' WHEN attempt_count + 1 >= 3 THEN 'job_retry_exhausted'
              ELSE 'job_requeued' END AS outcome FROM stale)""",
        select="""
SELECT job_id, status, outcome,
       CASE outcome WHEN 'job_already_activated' THEN 'succeeded' WHEN 'job_retry_exhausted' THEN 'failed' ELSE 'retry_wait' END AS new_status,
       attempt_count + CASE WHEN outcome = 'job_already_activated' THEN 0 ELSE 1 END AS new_attempts,
       CASE WHEN outcome = 'job_retry_exhausted' THEN CASE WHEN active_version_id IS NOT NULL THEN 'ready' ELSE 'failed' END
            ELSE document_status END AS new_document_status,
       CASE WHEN outcome = 'job_requeued' THEN 'recover:' || job_id || ':' || (attempt_count + 1) END AS event_key
FROM decided""",
    ),
    "wiki_stale_recovery": S.sql(
        KEYED, STATE,
        select="""
SELECT job_id, epoch_us(heartbeat_at) AS heartbeat_us FROM job_state
WHERE status = 'running' AND heartbeat_at < TIMESTAMP '2024-01-30 23:25:00' ORDER BY heartbeat_at, job_id LIMIT 100""",
    ),
    "wiki_failure_retry": S.sql(
        KEYED, STATE,
        select="""
SELECT job_id, CASE WHEN attempt_count + 1 >= 3 THEN 'failed' ELSE 'retry_wait' END AS new_status,
       CASE WHEN attempt_count + 1 < 3 THEN CAST(least(300, pow(2, attempt_count + 1)) AS BIGINT) END AS delay_seconds,
       CASE WHEN attempt_count + 1 < 3 THEN 'wiki-retry:' || job_id || ':' || (attempt_count + 1) END AS event_key
FROM job_state WHERE status IN ('failed', 'running')""",
    ),
    "durable_retry": S.sql(
        KEYED, STATE,
        """failures AS (
  SELECT user_id + CASE WHEN k = 7 THEN 100000 ELSE 0 END AS job_id, min(k % 9) AS retries
  FROM ev WHERE event_type = 'error' GROUP BY 1),
decided AS (
  SELECT f.*, j.attempt_count, CASE WHEN j.status IS NULL THEN 'ingestion_job_not_found'
           WHEN j.status IN ('succeeded', 'retry_wait') THEN 'already_settled' WHEN j.attempt_count >= 3 THEN 'retry_exhausted'
           ELSE 'scheduled' END AS decision FROM failures f LEFT JOIN job_state j USING (job_id))""",
        select="""
SELECT job_id, decision, CASE WHEN decision = 'scheduled' THEN CAST(pow(2, least(retries, 6)) AS BIGINT) END AS delay_seconds,
       CASE WHEN decision = 'scheduled' THEN 'retry-job:' || job_id || ':' || (attempt_count + 1) END AS event_key
FROM decided""",
    ),
    "progress_tail": S.sql(
        S.DIM, KEYED, STATE,
        select="""
SELECT 'document_progress' AS type, d.doc_id, j.job_id, j.status, j.error_code, epoch_us(j.updated_at) AS updated_us
FROM job_state j JOIN documents_dim d ON d.doc_id = j.job_id
WHERE (j.updated_at, j.job_id) > (TIMESTAMP '2024-01-29 12:00:00', 50)""",
    ),
    "job_lifecycle": S.sql(
        KEYED,
        select="""
SELECT user_id AS job_id, arg_max(status, ts) AS status, count(*) FILTER (status = 'running') AS attempts, count(*) AS n_events,
       epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us
FROM ev GROUP BY 1""",
    ),
    "job_time_in_status": S.sql(
        KEYED,
        """steps AS (
  SELECT user_id AS job_id, status, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) // 1000000 AS seconds
  FROM ev)""",
        select="""
SELECT job_id, status, count(*) AS n_steps, CAST(coalesce(sum(seconds), 0) AS BIGINT) AS seconds FROM steps GROUP BY 1, 2""",
    ),
    "turn_registry": """
WITH words AS (
  SELECT conv_id AS turn_id, turn AS call_no, list_filter(string_split_regex(text, '[ \\n]+'), lambda w: length(w) >= 6) AS w FROM conversations),
found AS (SELECT turn_id, call_no, unnest(w) AS chunk_id, generate_subscripts(w, 1) - 1 AS place FROM words),
numbers AS (
  SELECT turn_id, chunk_id, row_number() OVER (PARTITION BY turn_id ORDER BY seen) AS number
  FROM (SELECT turn_id, chunk_id, min(call_no * 1000000 + place) AS seen FROM found GROUP BY 1, 2)),
told AS (
  SELECT f.*, n.number, min(CASE WHEN n.number > 8 THEN f.place END) OVER (PARTITION BY f.turn_id, f.call_no) AS stop
  FROM found f JOIN numbers n USING (turn_id, chunk_id))
SELECT turn_id, call_no, place, chunk_id, '[' || number || ']' AS citation_id
FROM told WHERE number <= 8 AND (stop IS NULL OR place < stop)""",
    "stream_event_order": """
WITH items AS (
  SELECT conv_id AS turn_id, turn AS seq, role = 'user' AS call, CASE WHEN role = 'assistant' THEN text ELSE '' END AS content,
         least(turn // 2, 8) AS n FROM conversations),
told AS (
  SELECT *, n > coalesce(lag(n) OVER w, 0) AS grown, min(CASE WHEN call THEN seq END) OVER p = seq AS first_call,
         min(CASE WHEN content <> '' THEN seq END) OVER p = seq AS first_text, max(seq) OVER p = seq AS last_item
  FROM items WINDOW w AS (PARTITION BY turn_id ORDER BY seq), p AS (PARTITION BY turn_id))
SELECT turn_id, seq, 0 AS part, 'sources' AS event, CAST(n AS VARCHAR) AS detail FROM told WHERE grown
UNION ALL SELECT turn_id, seq, 1, 'status', 'retrieving' FROM told WHERE first_call
UNION ALL SELECT turn_id, seq, 2, 'status', 'generating' FROM told WHERE first_text
UNION ALL SELECT turn_id, seq, 3, 'message', content FROM told WHERE content <> ''
UNION ALL SELECT turn_id, seq, 4, 'done', '' FROM told WHERE last_item""",
    "stream_dedup_ingest": """
SELECT DISTINCT event_type || ':' || user_id || ':' || CAST(json_extract(props, '$.k') AS VARCHAR) AS event_key,
       CASE e.event_type WHEN 'signup' THEN 'document.ingestion.requested' WHEN 'purchase' THEN 'document.deletion.requested'
         WHEN 'view' THEN 'document.version.cleanup.requested' WHEN 'click' THEN 'wiki.document.generate.requested'
         ELSE 'unknown.event' END AS event_type,
       CASE e.event_type WHEN 'signup' THEN 'ingest' WHEN 'purchase' THEN 'delete_document' WHEN 'view' THEN 'cleanup_version'
         WHEN 'click' THEN 'generate_wiki' ELSE 'dead_letter' END AS route
FROM events e""",
    "stream_incremental_ingest": """
SELECT CAST(doc_id AS VARCHAR) AS version_id, CAST(sum((length(line) + 199) // 200) AS BIGINT) AS n_children, CAST(sum(length(line)) AS BIGINT) AS n_chars
FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE line <> '' GROUP BY 1""",
    "stream_job_lifecycle": S.sql(
        KEYED, select="SELECT user_id AS job_id, arg_max(status, ts) AS status, count(*) AS n_events FROM ev GROUP BY 1"
    ),
    "stream_citation_filter": S.sql(MESSAGES, FILTERED, select="SELECT conv_id, turn, text FROM filtered"),
    "stream_citation_lost": S.sql(
        MESSAGES.replace("messages AS", "sent AS"),
        """messages AS (
  SELECT conv_id, turn,
         CASE WHEN conv_id % 3 <> 1 THEN text
              ELSE substr(text, 1, least(7, length(text) - 1 - (length(text) - 1) % 7))
                   || substr(text, 15, greatest((length(text) - 1) // 7 * 7 - 14, 0)) END AS text
  FROM sent)""",
        FILTERED,
        select="SELECT conv_id, turn, text, conv_id % 3 = 1 AS expired FROM filtered",
    ),
    "stream_dedup_history": """
WITH keyed AS (
  SELECT event_id % 2 AS half, event_type || ':' || user_id || ':' || CAST(json_extract(props, '$.k') AS VARCHAR) AS event_key FROM events),
told AS (SELECT event_key, min(half) AS epoch FROM keyed GROUP BY 1),
sizes AS (
  SELECT half AS epoch, count(*) AS n FROM keyed GROUP BY 1 UNION ALL SELECT 2, count(*) FROM keyed)
SELECT CAST(s.epoch AS BIGINT) AS epoch, (SELECT count(*) FROM told t WHERE t.epoch = s.epoch) AS accepted,
       CAST(s.n - (SELECT count(*) FROM told t WHERE t.epoch = s.epoch) AS BIGINT) AS acknowledged
FROM sizes s""",
}
