"""Structured Streaming jobs: idempotent consumption, incremental ingestion, citation filtering."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators import chunking
from corpusloom.plans.ingest import build_versions, version_outcomes
from corpusloom.session import checkpoint_root, pinned
from corpusloom.streaming.jobs import route

FLUSH_ABOVE = 16


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one stream run under the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/streams/{name}-{uuid.uuid4().hex}"


def run_available(
    stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> None:
    """Process what is there in micro-batches and stop; the checkpoint carries on next time."""
    query = (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _epochs_before(spark: SparkSession, folder: str, epoch: int, schema: str) -> DataFrame:
    """What earlier micro-batches wrote; a repeated batch does not see its own first attempt."""
    if epoch == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, epoch long").parquet(folder).where(F.col("epoch") < epoch).drop("epoch")


BUCKETS = 4096
WORDS = 1 << 20
MARKS = 4
HISTORY = "event_key string, event_type string, route string, bucket int"
BLOOM = "bucket int, word int, bits long"


def key_places(key: Column) -> dict[str, Column]:
    """Bucket, word and bits of a key in the Bloom table: one word per key, `MARKS` bits in it.

    There are `BUCKETS` * `WORDS` words, so about 2^34 keys stay below four keys a word; beyond that
    more keys pass the table and are looked up in the history, with the same result.
    """
    place = F.xxhash64(key)
    marks = F.xxhash64(key, F.lit("bits"))
    bits = F.lit(0).cast("long")
    for n in range(MARKS):
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(marks, 6 * n).bitwiseAND(F.lit(63)).cast("int")))
    return {
        "bucket": F.pmod(place, F.lit(BUCKETS)).cast("int"),
        "word": F.pmod(F.shiftrightunsigned(place, 16), F.lit(WORDS)).cast("int"),
        "bits": bits,
    }


def _known_keys(spark: SparkSession, arrived: DataFrame, folder: str, epoch: int) -> DataFrame:
    """Keys of `arrived` that an earlier micro-batch accepted.

    The Bloom table, some two bytes a key, tells which keys may be known. Only those are joined with the
    history, and only the buckets they fall in are read: the history is sorted by bucket, so other row
    groups are skipped by their bounds.
    """
    words = _epochs_before(spark, f"{folder}/bloom", epoch, BLOOM).groupBy("bucket", "word").agg(
        F.bit_or("bits").alias("seen")
    )
    perhaps = pinned(
        arrived.join(words, ["bucket", "word"]).where(F.col("seen").bitwiseAND(F.col("bits")) == F.col("bits")).select(
            "bucket", "event_key"
        )
    )
    buckets = [row["bucket"] for row in perhaps.select("bucket").distinct().collect()]  # at most BUCKETS numbers
    history = _epochs_before(spark, f"{folder}/events", epoch, HISTORY).where(F.col("bucket").isin(buckets))
    return perhaps.join(history.select("bucket", "event_key"), ["bucket", "event_key"], "left_semi")


def consume_events(events: DataFrame, folder: str) -> None:
    """Consume a stream of (event_key, event_type) once per key and route it by type.

    A micro-batch is evaluated once: one row per key with its number of arrivals is written, then told
    apart by the keys that earlier batches accepted. Of one key's events in a batch the least type counts.
    An event without a key cannot be told from others and is dropped as acknowledged. Accepted events go
    to `folder/events`, their Bloom words to `folder/bloom`, the number acknowledged without effect to
    `folder/acknowledged`, all by epoch, so a retried batch rewrites itself.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        counted = batch.groupBy("event_key").agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"))
        arrivals = counted.withColumn("route", route(F.col("event_type"))).withColumns(key_places(F.col("event_key")))
        arrivals.write.mode("overwrite").parquet(f"{folder}/arrived/epoch={epoch}")
        arrived = spark.read.schema(arrivals.schema).parquet(f"{folder}/arrived/epoch={epoch}")
        keyed = arrived.where("event_key IS NOT NULL")
        fresh = keyed.join(_known_keys(spark, keyed, folder, epoch), ["bucket", "event_key"], "left_anti")
        target = f"{folder}/events/epoch={epoch}"
        (
            fresh.select("event_key", "event_type", "route", "bucket")
            .repartitionByRange("bucket", "event_key")
            .sortWithinPartitions("bucket", "event_key")
            .write.mode("overwrite")
            .parquet(target)
        )
        accepted = spark.read.schema(HISTORY).parquet(target)
        marked = accepted.select(*(c.alias(name) for name, c in key_places(F.col("event_key")).items()))
        words = marked.groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
        words.write.mode("overwrite").parquet(f"{folder}/bloom/epoch={epoch}")
        both = arrived.select(F.col("n").alias("n")).unionByName(accepted.select(F.lit(-1).cast("long").alias("n")))
        told = both.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("acknowledged"))
        told.write.mode("overwrite").parquet(f"{folder}/acknowledged/epoch={epoch}")

    run_available(events, step, f"{folder}/checkpoint")


def ingest_versions(
    versions: DataFrame,
    folder: str,
    embedder: Callable[[Column], Column],
    dimension: int,
    child_characters: int = chunking.CHILD_CHARACTERS,
) -> None:
    """Build the versions of a stream (version_id, sections, ...) as they arrive.

    Only versions that verify are added to the index; earlier index rows are not touched, so new
    uploads become searchable without a rebuild. Children are embedded once, into `folder/built`; the
    outcomes count what was written there.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        built = build_versions(batch, embedder, dimension, child_characters)
        rows = built["index"].select("version_id", "chunk_id", "kb_id", "content", "vector")
        rows.write.mode("overwrite").parquet(f"{folder}/built/epoch={epoch}")
        index = spark.read.schema(rows.schema).parquet(f"{folder}/built/epoch={epoch}")
        target = f"{folder}/outcomes/epoch={epoch}"
        version_outcomes(batch, index, child_characters).write.mode("overwrite").parquet(target)
        ready = spark.read.parquet(target).where("status = 'ready'").select("version_id")
        index.join(ready, "version_id", "left_semi").write.mode("overwrite").parquet(f"{folder}/index/epoch={epoch}")

    run_available(versions, step, f"{folder}/checkpoint")


def follow_lifecycle(log: DataFrame, folder: str) -> None:
    """Keep the newest state of each job of a stream (job_id, ts, event_id, status).

    The state is one row per job; every micro-batch writes the jobs it changed.
    """
    state = log.groupBy("job_id").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"),
        F.count(F.lit(1)).alias("n_events"),
        F.max(F.struct("ts", "event_id")).alias("at"),
    )

    def step(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/state/epoch={epoch}")

    run_available(state, step, f"{folder}/checkpoint", mode="update")


def newest_states(spark: SparkSession, folder: str) -> DataFrame:
    """The last state written per job over all micro-batches."""
    written = spark.read.parquet(f"{folder}/state")
    return written.groupBy("job_id").agg(
        F.max_by(F.struct("status", "n_events"), F.struct("n_events", "epoch")).alias("s")
    ).select("job_id", F.col("s.status").alias("status"), F.col("s.n_events").alias("n_events"))


_PIECE = re.compile(r"\[[^\]]*\]|[^\[]+")
_MARK = re.compile(r"\[([0-9]{1,3})\]")


def filter_fragment(pending: str, fragment: str, available: int) -> tuple[str, str]:
    """(text to emit, text to hold back) after one more fragment.

    An open bracket is held back until it closes or more than sixteen characters wait.
    """
    text, at, kept = pending + fragment, 0, []
    while at < len(text):
        piece = _PIECE.match(text, at)
        if piece is None:
            if len(text) - at <= FLUSH_ABOVE:
                break
            kept.append(text[at])
            at += 1
            continue
        mark = _MARK.fullmatch(piece.group())
        if mark is None or 1 <= int(mark.group(1)) <= available:
            kept.append(piece.group())
        at = piece.end()
    return "".join(kept), text[at:]


MESSAGE_STATE = "next_no long, pending string, waiting string, done boolean"
PIECES = "message_id string, fragment_no long, piece string, expired boolean"


def _emit(state: MessageState, available: int) -> list[tuple[int, str]]:
    """Filtered pieces of the waiting fragments that follow without a gap; updates the state."""
    pieces = []
    while not state.done and state.next_no in state.waiting:
        fragment, last = state.waiting.pop(state.next_no)
        piece, state.pending = filter_fragment(state.pending, fragment, available)
        if last:
            piece, state.pending, state.done = piece + state.pending, "", True
        pieces.append((state.next_no, piece))
        state.next_no += 1
    if state.done:
        state.waiting.clear()
    return pieces


def _flush(state: MessageState, available: int) -> list[tuple[int, str]]:
    """What is left of a message without an end, in order, as if the lost fragments were empty."""
    pieces, number = [], state.next_no
    for number in sorted(state.waiting):
        piece, state.pending = filter_fragment(state.pending, state.waiting[number][0], available)
        pieces.append((number, piece))
    if state.pending:
        pieces.append((number + 1, state.pending))
    return pieces


@dataclass
class MessageState:
    """Next fragment wanted, text held back, fragments ahead of a gap, whether the message has ended."""

    next_no: int
    pending: str
    waiting: dict[int, tuple[str, bool]]
    done: bool

    @classmethod
    def of(cls, state: GroupState) -> MessageState:
        if not state.exists:
            return cls(0, "", {}, False)
        next_no, pending, waiting, done = state.get
        return cls(next_no, pending, {int(n): tuple(f) for n, f in json.loads(waiting).items()}, done)

    def row(self) -> tuple[int, str, str, bool]:
        return self.next_no, self.pending, json.dumps(self.waiting), self.done


def filter_citations(fragments: DataFrame, folder: str, available: int = 8, delay: str = "1 hour") -> None:
    """Filter the citation marks of message fragments that arrive in any order over micro-batches.

    `fragments` is a stream (message_id, fragment_no from 0, fragment, last, sent_at). State per message
    holds the text after an open bracket and the fragments ahead of a gap. A repeated fragment has no
    effect; a null one is empty. Once the watermark is `delay` past a message's newest fragment, its state
    is dropped: a message that had not ended is flushed over its gaps, with `expired` true. An ended
    message keeps its state until then, so that late repeats are not taken for a new message; rows older
    than the watermark of the batch before are dropped by Spark. Filtered pieces go to `folder/pieces`.
    """
    late = int(pd.Timedelta(delay).total_seconds() * 1000)

    def step_message(
        key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        message = MessageState.of(state)
        expired = state.hasTimedOut
        if expired:
            pieces = [] if message.done else _flush(message, available)
            state.remove()
        else:
            newest = 0
            for rows in batches:
                newest = max(newest, int(rows["sent_at"].max().timestamp() * 1000))
                for row in rows.itertuples():
                    if row.fragment_no >= message.next_no and not message.done:
                        message.waiting.setdefault(int(row.fragment_no), (row.fragment or "", bool(row.last)))
            pieces = _emit(message, available)
            state.update(message.row())
            state.setTimeoutTimestamp(max(newest + late, state.getCurrentWatermarkMs() + 1))
        columns = PIECES.replace(",", "").split()[::2]
        yield pd.DataFrame([(key[0], number, piece, expired) for number, piece in pieces], columns=columns)

    filtered = (
        fragments.withWatermark("sent_at", delay)
        .groupBy("message_id")
        .applyInPandasWithState(step_message, PIECES, MESSAGE_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/pieces/epoch={epoch}")

    run_available(filtered, write, f"{folder}/checkpoint")


def whole_messages(spark: SparkSession, folder: str) -> DataFrame:
    """(message_id, text, expired): the filtered pieces joined in order; a message is one bounded text."""
    pieces = spark.read.schema(f"{PIECES}, epoch long").parquet(f"{folder}/pieces")
    return pieces.groupBy("message_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("fragment_no", "piece"))), lambda p: p["piece"]), ""
        ).alias("text"),
        F.bool_or("expired").alias("expired"),
    )
