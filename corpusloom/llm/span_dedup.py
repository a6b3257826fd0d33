"""Sliding sentence spans: sentences inside a repeated run go, except in its first place.

A run is `SPAN` sentences, or two sentences of `PAIR_WORDS` words or more together.

A sentence ends at a word that ends in a full stop, exclamation or question mark, or before a line break. Each
run is hashed in its task, one of SPAN sentences only where two runs of two do not cover it; the runs met twice or more are found by a map-side
aggregate that keeps the first place (least doc_id, then least sentence), and a join of narrow rows marks the
later places. A document of fewer sentences is one run. Only places and hashes are shuffled until the marks
meet the texts, by document.

Null and empty texts have no sentences and are kept. A document whose sentences are all covered keeps an empty
text. Rows that repeat a doc_id and text are one document, one doc_id on
different texts makes different ones, in the order of a hash of the text; a null doc_id sorts last. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import Hasher, Texts, runs_of, slices, texts_of
from corpusloom.llm.tables import numbered_documents, stored

SPAN = 3
PAIR_WORDS = 8
SLICE = 1 << 18  # bytes of text worked on at once: bounds the memory of a task's arrays


def sentences(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of all sentences."""
    starts, ends, owner = texts.words()
    if not len(starts):
        return starts, ends, owner
    closing = np.isin(texts.data[ends - 1], np.frombuffer(b".!?", dtype=np.uint8))
    breaks = np.concatenate(([0], np.cumsum(texts.data == 10)))
    closing[:-1] |= breaks[starts[1:]] > breaks[ends[:-1]]
    closing[-1] = True
    last = np.flatnonzero(closing)
    first = np.append(0, last[:-1] + 1)
    return starts[first], ends[last], owner[first]


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in slices(batches, "text", SLICE):
        texts = texts_of(batch.column("text"))
        starts, ends, owner = sentences(texts)
        hashes = hasher.spans(hasher.prefix(texts.data), starts, ends)
        count = np.bincount(owner, minlength=len(texts))
        first = np.cumsum(count) - count
        begin, _, _ = texts.words()
        words = np.searchsorted(begin, ends) - np.searchsorted(begin, starts)
        wide = np.zeros(len(owner), dtype=bool)
        wide[:-1] = (owner[:-1] == owner[1:]) & (words[:-1] + words[1:] >= PAIR_WORDS)
        keys, at, size = [], [], []
        for k in range(1, SPAN + 1):
            runs = runs_of(hashes, k)
            place = np.arange(len(runs))
            real = (owner[place] == owner[place + k - 1]) & ((k == SPAN) | (count[owner[place]] == k))
            if k == 2:
                real |= wide[place]
            elif k == SPAN:
                real &= ~(wide[place] & wide[place + 1])
            keys.append((runs[real] ^ np.uint64(k)).view(np.int64))
            at.append(place[real])
            size.append(np.full(int(real.sum()), k))
        at, size = np.concatenate(at), np.concatenate(size)
        ids = batch.column("did").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(keys)), pa.array(ids[owner[at]]), pa.array(((at - first[owner[at]]) * (SPAN + 1) + size).astype(np.int32))],
            names=["key", "did", "at"],
        )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE):
        texts = texts_of(batch.column("text"))
        starts, _, owner = sentences(texts)
        count = np.bincount(owner, minlength=len(texts))
        first = np.cumsum(count) - count
        kept, removed = [], []
        for i, ats in enumerate(batch.column("ats").to_pylist()):
            begin, end = texts.offsets[i], texts.offsets[i + 1] - 1
            body = texts.data[begin:end]
            gone = np.zeros(count[i], dtype=bool)
            if ats and count[i]:
                at, size = np.divmod(np.unique(np.array(ats)), SPAN + 1)
                for k in range(SPAN):
                    gone[at[k < size] + k] = True
                edge = np.append(starts[first[i] : first[i] + count[i]], end) - begin
                stay = np.repeat(np.append(True, ~gone), np.diff(np.append(0, edge)))
                body = body[stay]
            kept.append(body.tobytes())
            removed.append(int(gone.sum()))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(count.astype(np.int64)),
                pa.array(removed, pa.int64()),
                pa.array(kept, pa.binary()).cast(pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
            ],
            names=["doc_id", "n_sentences", "n_removed", "kept", "kept_sha256"],
        )


def later_places(texts: DataFrame) -> DataFrame:
    """(did, ats): where a run starts that has been met before, by sentence, times SPAN + 1 plus its sentences."""
    rows = texts.mapInArrow(_span_rows, "key long, did long, at int")
    place = F.struct("did", "at")
    first = rows.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = stored(first.select("key", F.col("first.did").alias("d0"), F.col("first.at").alias("a0")))
    later = rows.join(first, "key").where("did <> d0 or at <> a0")
    return later.groupBy("did").agg(F.collect_list("at").alias("ats"))


def remove_repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_removed, kept and kept_sha256 of every document."""
    rows, _ = numbered_documents(docs)
    texts = rows.select("doc_id", F.col("__did").alias("did"), F.coalesce("text", F.lit("")).alias("text"))
    joined = texts.join(later_places(texts), "did", "left")
    schema = "doc_id long, n_sentences long, n_removed long, kept string, kept_sha256 string"
    return joined.select("doc_id", "text", "ats").mapInArrow(_cut, schema)
