"""Exact substring removal over a sparse suffix array of the whole corpus.

A byte goes if some string of `WINDOW` bytes that covers it also starts earlier: in a document of smaller
doc_id, or earlier in the same one. Sorting all suffixes would move many times the corpus, so suffixes are
taken at anchors only: the least-hashed `GRAM`-byte string of each window. Equal windows have equal anchors,
so every repeat is met at an anchor.

1. Of equal texts, told by their SHA-256, only the one of least number goes on; the others are repeats from end
   to end. Each text is cut into *blocks*: runs of consecutive windows with one anchor (at most `SPAN` windows).
   Anchors met once in the corpus are dropped after a map-side aggregate.
2. The blocks of repeated anchors are range-partitioned by sampled splitters on the anchored suffix's leading
   bytes, then block, document and position, so that a hot anchor is dealt over several buckets. Their number
   follows from the bytes of text, so a bucket fits in a task whatever the size of the corpus.
3. A bucket collapses equal blocks, sorts the windows that may repeat by multikey quicksort on 8-byte tokens
   and compares neighbours. The first and the last anchor of a bucket may go on in the next one: their
   distinct windows are compared across the boundaries by an aggregate.
4. Covered ranges are gathered per document and cut out.

Null and empty texts have nothing to remove. Documents shorter than a window are kept whole. Rows that repeat
a doc_id and its text count as one document and each is returned; one doc_id on different texts makes different
documents, in the order of a hash of the text; a null doc_id sorts last. Other columns are
not read. The text is shuffled once: all joins by document read that one exchange, for which they take the same
columns of it. The rest are narrow rows and the blocks of repeated anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import BASE, Hasher, bytes_of, mixed, slices
from corpusloom.llm.tables import numbered_documents

WINDOW = 100
GRAM = 20  # 16 + 4, as gram_hashes builds them
SPAN = WINDOW - GRAM + 1
BUCKET_BYTES = 12 << 20  # of text for each bucket of the sort; a task holds about thirty times that


def gram_hashes(values: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte strings, built from strings of 4 and 16 bytes."""

    def twice(h: np.ndarray, length: int, other: np.ndarray | None = None) -> np.ndarray:
        right = h if other is None else other
        power = np.uint64(pow(BASE, length, 2**64))
        n = min(len(h), len(right) - length)
        return h[:n] + right[length : length + n] * power

    one = values[data]
    two = twice(one, 1)
    four = twice(two, 2)
    eight = twice(four, 4)
    sixteen = twice(eight, 8)
    return mixed(twice(sixteen, 16, four))


def running_min(h: np.ndarray, width: int) -> np.ndarray:
    out, length = h, 1
    while 2 * length <= width:
        out = np.minimum(out[:-length], out[length:])
        length *= 2
    rest = width - length
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def blocks_of(values: np.ndarray, data: np.ndarray, offsets: np.ndarray):
    """Anchor hash, text number, start, number of windows and anchor offset of every block."""
    if len(data) < WINDOW:
        none = np.empty(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none, none
    grams = gram_hashes(values, data)
    least = running_min(grams, SPAN)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    inside = np.arange(len(least)) + WINDOW <= ends
    new = np.empty(len(least), dtype=bool)
    new[0] = True
    new[1:] = least[1:] != least[:-1]
    new[offsets[(offsets < len(least)) & (offsets > 0)]] = True
    new[1:] |= inside[1:] != inside[:-1]
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(least)))
    real = inside[starts]
    starts, counts = starts[real], counts[real]
    pieces = -(-counts // SPAN)
    which = np.repeat(np.arange(len(starts)), pieces)
    part = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = starts[which] + part * SPAN
    counts = np.minimum(counts[which] - part * SPAN, SPAN)
    keys = least[starts]
    anchors = (grams[starts[:, None] + np.arange(SPAN)] == keys[:, None]).argmax(axis=1)
    # A block in which the anchor itself repeats may hold equal windows: an empty block makes its anchor repeated.
    final = starts + counts - 1
    moved = (grams[final[:, None] + np.arange(SPAN)] == keys[:, None]).argmax(axis=1) + counts - 1 != anchors
    keys, starts, anchors = (np.append(x, x[moved]) for x in (keys, starts, anchors))
    counts = np.append(counts, np.zeros(int(moved.sum()), dtype=counts.dtype))
    text = np.searchsorted(offsets, starts, side="right") - 1
    return keys, text, starts - offsets[text], counts, anchors


def packed(start: np.ndarray, anchor: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << 14) | (anchor.astype(np.int64) << 7) | count.astype(np.int64)


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    values = Hasher().values
    for batch in slices(batches, "text", 1 << 18):
        data, offsets = bytes_of(batch.column("text"))
        keys, text, start, count, anchor = blocks_of(values, data, offsets)
        ids = batch.column("did").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.view(np.int64)), pa.array(ids[text]), pa.array(packed(start, anchor, count))],
            names=["key", "did", "at"],
        )


def _block_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the blocks whose anchors repeat."""
    for batch in slices(batches, "text"):
        data, offsets = bytes_of(batch.column("text"))
        lists = batch.column("ats")
        at = lists.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        start, anchor, count = at >> 14, (at >> 7) & 127, at & 127
        first = offsets[row] + start
        length = count + WINDOW - 1
        fits = (count > 0) & (first + length <= offsets[row + 1])
        row, start, anchor, first, length = (x[fits] for x in (row, start, anchor, first, length))
        cut = np.concatenate(([0], np.cumsum(length)))
        index = np.arange(cut[-1]) - np.repeat(cut[:-1] - first, length)
        block = pa.Array.from_buffers(
            pa.binary(), len(row), [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(data[index].tobytes())]
        )
        head = data[(first + anchor)[:, None] + np.arange(GRAM)]
        heads = pa.Array.from_buffers(
            pa.binary(),
            len(row),
            [None, pa.py_buffer((np.arange(len(row) + 1) * GRAM).astype(np.int32)), pa.py_buffer(head.tobytes())],
        )
        ids = batch.column("did").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays(
            [heads, block, pa.array(ids[row]), pa.array(start)], names=["head", "block", "did", "start"]
        )


def multikey_groups(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Group numbers of equal windows: ties are split token by token, and only ties go on to the next token."""
    token_at = [*range(0, WINDOW - 8, 8), WINDOW - 8]
    group = np.zeros(len(starts), dtype=np.int64)
    live = np.arange(len(starts))
    shift = np.arange(8)
    for at in token_at:
        if not len(live):
            break
        token = data[(starts[live] + at)[:, None] + shift].view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((token, group[live]))
        live, token = live[order], token[order]
        old = group[live]
        new = np.append(True, (old[1:] != old[:-1]) | (token[1:] != token[:-1]))
        group[live] = np.cumsum(new) - 1
        size = np.diff(np.append(np.flatnonzero(new), len(live)))
        tied = np.repeat(size > 1, size)
        group[live[~tied]] = -1
        live = live[tied]
    return group


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered ranges of one bucket, and the distinct windows of its first and last anchor."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got)
    heads = table["head"].combine_chunks()
    code = table["block"].combine_chunks().dictionary_encode()
    did = table["did"].to_numpy()
    start = table["start"].to_numpy()
    codes = code.indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((start, did, codes))
    codes, did, start = codes[order], did[order], start[order]
    new = np.append(True, codes[1:] != codes[:-1])
    same = np.append(False, (codes[1:] == codes[:-1]) & (did[1:] == did[:-1]) & (start[1:] == start[:-1]))
    data, cut = bytes_of(code.dictionary)
    length = np.diff(cut)
    copy = ~new & ~same
    out = [(did[copy], start[copy], start[copy] + length[codes[copy]])]
    rep_did, rep_start = did[new], start[new]  # by code, as codes are dense
    rep_head = heads.take(pa.array(order[new]))
    number = length - WINDOW + 1
    block = np.repeat(np.arange(len(number), dtype=np.int32), number)
    offset = np.arange(len(block)) - np.repeat(np.cumsum(number) - number, number)
    at = cut[block] + offset
    hasher = Hasher()
    hashes = hasher.spans(hasher.prefix(data), at, at + WINDOW)
    by_hash = np.argsort(hashes)
    sorted_hashes = hashes[by_hash]
    differs = sorted_hashes[1:] != sorted_hashes[:-1]
    single = np.append(True, differs) & np.append(differs, True)
    maybe = np.sort(by_hash[~single])
    group = multikey_groups(data, at[maybe])
    del hashes, by_hash, sorted_hashes, differs, single
    tied = group >= 0
    maybe, group = maybe[tied], group[tied]
    order = np.lexsort((rep_start[block[maybe]] + offset[maybe], rep_did[block[maybe]], group))
    maybe, group = maybe[order], group[order]
    later = np.append(False, group[1:] == group[:-1]) if len(group) else np.zeros(0, dtype=bool)
    covered = np.zeros(len(block), dtype=bool)
    covered[maybe[later]] = True
    edge = np.flatnonzero(covered)
    if len(edge):
        breaks = np.append(True, (edge[1:] != edge[:-1] + 1) | (block[edge[1:]] != block[edge[:-1]]))
        first = edge[breaks]
        last = edge[np.append(np.flatnonzero(breaks)[1:] - 1, len(edge) - 1)]
        owner = block[first]
        out.append((rep_did[owner], rep_start[owner] + offset[first], rep_start[owner] + offset[last] + WINDOW))
    did, start, end = (np.concatenate(x) for x in zip(*out, strict=True))
    yield pa.RecordBatch.from_arrays(
        [pa.array(did), pa.array(start), pa.array(end), pa.nulls(len(did), pa.binary())],
        names=["did", "start", "end", "window"],
    )
    head_values = np.array(rep_head.to_pylist(), dtype=object)
    edges = {min(head_values), max(head_values)}
    is_open = np.fromiter((h in edges for h in head_values), dtype=bool, count=len(head_values))
    for at_once in np.array_split(np.flatnonzero(is_open[block] & ~covered), 1 + int(is_open[block].sum()) // 50_000):
        owner = block[at_once]
        windows = data[at[at_once][:, None] + np.arange(WINDOW)]
        values = pa.Array.from_buffers(
            pa.binary(),
            len(at_once),
            [None, pa.py_buffer((np.arange(len(at_once) + 1) * WINDOW).astype(np.int32)), pa.py_buffer(windows.tobytes())],
        )
        begin = rep_start[owner] + offset[at_once]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rep_did[owner]), pa.array(begin), pa.array(begin + WINDOW), values],
            names=["did", "start", "end", "window"],
        )


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        data, offsets = bytes_of(batch.column("text"))
        kept, removed, spans = [], [], []
        copies = batch.column("copy").to_pylist()
        for i, ranges in enumerate(batch.column("ranges").to_pylist()):
            body = data[offsets[i] : offsets[i + 1]]
            if copies[i] and len(body) >= WINDOW:
                ranges = [{"start": 0, "end": len(body)}]
            if not ranges:
                kept.append(body.tobytes())
                removed.append(0)
                spans.append(0)
                continue
            edges = np.zeros(len(body) + 1, dtype=np.int32)
            pairs = np.array([(r["start"], r["end"]) for r in ranges], dtype=np.int64)
            np.add.at(edges, pairs[:, 0], 1)
            np.add.at(edges, pairs[:, 1], -1)
            gone = np.cumsum(edges[:-1]) > 0
            kept.append(body[~gone].tobytes())
            removed.append(int(gone.sum()))
            spans.append(int(np.count_nonzero(gone & ~np.append(False, gone[:-1]))))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(np.diff(offsets)),
                pa.array(removed, pa.int64()),
                pa.array(spans, pa.int64()),
                pa.array(kept, pa.binary()),
                pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
        )


def first_texts(texts: DataFrame) -> DataFrame:
    """did: the least number of each text."""
    return texts.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("did").alias("did")).select("did")


def repeated_ranges(texts: DataFrame, firsts: DataFrame) -> DataFrame:
    """(did, ranges): the byte ranges to remove from each document that has any, of those in `firsts`."""
    originals = texts.join(firsts.hint("shuffle_hash"), "did", "left_semi")
    blocks = originals.mapInArrow(_block_rows, "key long, did long, at long")
    repeated = blocks.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    candidates = blocks.join(repeated, "key").groupBy("did").agg(F.collect_list("at").alias("ats"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    number = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    suffixes = texts.join(candidates, "did").mapInArrow(_block_texts, "head binary, block binary, did long, start long")
    buckets = suffixes.repartitionByRange(number, "head", "block", "did", "start")
    judged = buckets.mapInArrow(_bucket, "did long, start long, end long, window binary")
    own = F.when(F.col("window").isNull(), F.col("did")).alias("own")
    places = judged.groupBy("window", own).agg(F.collect_list(F.struct("did", "start", "end")).alias("places"))
    later = F.slice(F.array_sort("places"), F.lit(2), F.size("places"))
    covered = places.select(F.explode(F.when(F.col("window").isNull(), F.col("places")).otherwise(later)).alias("p"))
    return covered.select("p.*").groupBy("did").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (remaining bytes) and kept_sha256 of every document."""
    rows, _ = numbered_documents(docs)
    texts = rows.select("doc_id", F.col("__did").alias("did"), F.coalesce("text", F.lit("")).alias("text"))
    # Every document has a number; said here, the joins read the same rows whichever kind they are.
    texts = texts.where("did is not null")
    firsts = first_texts(texts)
    marked = firsts.select("did", F.lit(True).alias("first")).hint("shuffle_hash")
    joined = texts.join(repeated_ranges(texts, firsts), "did", "left").join(marked, "did", "left")
    return joined.select("doc_id", "text", "ranges", F.col("first").isNull().alias("copy")).mapInArrow(
        _cut_out,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string",
    )
