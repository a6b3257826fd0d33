"""Jaccard join on five-word shingles by a MinHash LSH forest.

Each text gets `TREES` labels of `DEEPEST` MinHash values. The labels of a tree are a sorted prefix trie:
texts that share a prefix are neighbours in it. Starting from the deepest prefix, the matched prefix is
shortened level by level until a pair at the threshold is expected to share one in some tree with probability
`RECALL`; texts that share a prefix of that length are candidates. Candidates are verified exactly.

Texts of equal shingle multisets are one *text*: copies collapse before anything is matched. Candidate groups
are star links to the least member, never all pairs. The candidate components are cut into chunks of about
`CHUNK` texts by hash; every pair of chunks of a component is verified in one bounded group by products of
incidence matrices, which counts all links of a text and passes on a spanning forest only.

Words are lower-cased runs without white space. A text of fewer than five words is one shingle. Texts without
words are copies of each other and have no links. Null texts count as empty; a null doc_id sorts last, and a class
of such documents alone has a null class_id. Rows that repeat a doc_id each get a
row; one doc_id on different texts makes different documents. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import Hasher, mixed, runs_of, slices, texts_of
from corpusloom.llm.components import components
from corpusloom.llm.tables import numbered_documents, stored

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.98
TREES = 16
DEEPEST = 8
CHUNK = 48
LAST = 2**63 - 1


def depth_for(similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """Shorten the prefix from the deepest level until the expected recall at the threshold is reached."""
    depth = DEEPEST
    while depth > 1 and 1 - (1 - similarity**depth) ** TREES < recall:
        depth -= 1
    return depth


def shingles(column: pa.Array, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in a row, and the number of each text's shingles."""
    lowered = pc.utf8_lower(column.fill_null("") if column.null_count else column)
    texts = texts_of(lowered)
    starts, ends, owner = texts.words()
    words = hasher.spans(hasher.prefix(texts.data), starts, ends)
    count = np.bincount(owner, minlength=len(texts))
    hashes, owners = [], []
    for k in range(1, WORDS + 1):
        runs = runs_of(words, k)
        at = np.arange(len(runs))
        real = (owner[at] == owner[at + k - 1]) & ((k == WORDS) | (count[owner[at]] == k))
        hashes.append(runs[real])
        owners.append(owner[at[real]])
    hashes, owners = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return hashes[order], np.bincount(owners, minlength=len(texts))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the shingle multiset and the labels of the trees, 16 bits a value."""
    hasher = Hasher()
    rng = np.random.default_rng(20240607)
    factors = rng.integers(0, 2**32, TREES * DEEPEST, dtype=np.uint32) | np.uint32(1)
    masks = rng.integers(0, 2**32, TREES * DEEPEST, dtype=np.uint32)
    for batch in slices(batches, "text"):
        hashes, count = shingles(batch.column("text"), hasher)
        some = np.flatnonzero(count)
        first = (np.cumsum(count) - count)[some]
        digest = np.zeros((2, len(count)), dtype=np.uint64)
        labels = np.zeros((len(count), TREES * DEEPEST), dtype=np.uint32)
        if len(some):
            digest[0, some] = np.add.reduceat(hashes, first)
            digest[1, some] = np.add.reduceat(mixed(hashes + np.uint64(count.dtype.itemsize)), first)
            short = (hashes >> np.uint64(32)).astype(np.uint32)
            for i in range(TREES * DEEPEST):
                labels[some, i] = np.minimum.reduceat((short ^ masks[i]) * factors[i], first)
        values = mixed(labels.astype(np.uint64)).astype(">u2")
        width = TREES * DEEPEST * 2
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("did"),
                pa.array(digest[0].view(np.int64)),
                pa.array(digest[1].view(np.int64)),
                pa.array(count.astype(np.int32)),
                pa.Array.from_buffers(
                    pa.binary(),
                    len(count),
                    [None, pa.py_buffer((np.arange(len(count) + 1) * width).astype(np.int32)), pa.py_buffer(values.tobytes())],
                ),
            ],
            names=["did", "d1", "d2", "n", "labels"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct shingles of each text."""
    hasher = Hasher()
    for batch in slices(batches, "text"):
        hashes, count = shingles(batch.column("text"), hasher)
        owner = np.repeat(np.arange(len(count)), count)
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        new = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))[: len(hashes)]
        hashes, owner = hashes[new], owner[new]
        cut = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(count))))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(hashes.view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("did", "component", "chunk", "chunks")), lists],
            names=["did", "component", "chunk", "chunks", "shingles"],
        )


def jaccard(lists: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarity of all sets with each other, from incidence matrices of shared shingles in slabs."""
    size = np.array([len(x) for x in lists], dtype=np.float64)
    owner = np.repeat(np.arange(len(lists)), size.astype(np.int64))
    _, at, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    used = shared[at]
    at, owner = number[at[used]], owner[used]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    common = np.zeros((len(lists), len(lists)), dtype=np.float64)
    for low in range(0, int(shared.sum()), 8192):
        a, b = np.searchsorted(at, (low, low + 8192))
        matrix = np.zeros((len(lists), 8192), dtype=np.float32)
        matrix[owner[a:b], at[a:b] - low] = 1
        common += matrix @ matrix.T
    union = size[:, None] + size[None, :] - common
    return common / np.maximum(union, 1)


def _verify(table: pa.Table) -> pa.Table:
    """Links of each text in one pair of chunks, and the least text it is connected with there."""
    did = table["did"].to_numpy()
    chunk = table["chunk"].to_numpy()
    same = table["c1"][0].as_py() == table["c2"][0].as_py()
    linked = jaccard([np.asarray(x.values) for x in table["shingles"]]) >= SIMILARITY
    np.fill_diagonal(linked, False)
    if not same:
        linked &= chunk[:, None] != chunk[None, :]
    links = linked.sum(axis=1)
    root = did.copy()
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], LAST).min(axis=1))
        if (least == root).all():
            break
        root = least
    some = links > 0
    return pa.table({"did": did[some], "root": root[some], "links": links[some].astype(np.int64)})


def similar_texts(docs: DataFrame) -> DataFrame:
    """did, class_id, n_links and n_copies of every document of `numbered_documents`.

    class_id is the least number of the connected group; n_links counts the different texts at a similarity of
    SIMILARITY or more; n_copies counts the documents of the same shingles, itself included.
    """
    texts = docs.select(F.col("__did").alias("did"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "did long, d1 long, d2 long, n int, labels binary"
    signed = stored(texts.mapInArrow(_signatures, schema))
    groups = signed.groupBy("d1", "d2", "n").agg(
        F.min("did").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("labels").alias("labels")
    )
    groups = stored(groups)
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    prefix = F.expr(f"substring(labels, tree * {2 * DEEPEST} + 1, {2 * depth_for()})").alias("prefix")
    cells = groups.where("n > 0").select("rep", "labels", tree).select("rep", "tree", prefix)
    shared = cells.groupBy("tree", "prefix").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(shared.select("tree", "prefix", "leader"))
    stars = cells.join(shared, ["tree", "prefix"]).where("rep <> leader").select(F.col("rep").alias("u"), F.col("leader").alias("v"))
    near = stored(components(stars))
    sizes = stored(near.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")))
    members = near.join(sizes, "component").select(
        F.col("node").alias("did"), "component", "chunks", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk")
    )
    sets = texts.join(members, "did").select("did", "text", "component", "chunk", "chunks")
    sets = sets.mapInArrow(_sets, "did long, component long, chunk int, chunks int, shingles array<long>")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    pairs = sets.select("did", "component", "chunk", "shingles", other).select(
        "did", "component", "chunk", "shingles", F.least("chunk", "other").alias("c1"), F.greatest("chunk", "other").alias("c2")
    )
    found = stored(pairs.groupBy("component", "c1", "c2").applyInArrow(_verify, "did long, root long, links long"))
    links = found.groupBy("did").agg(F.sum("links").alias("n_links"))
    classes = components(found.select(F.col("did").alias("u"), F.col("root").alias("v")))
    named = groups.join(links, groups["rep"] == links["did"], "left").join(classes, F.col("rep") == F.col("node"), "left")
    named = stored(
        named.select(
            "d1", "d2", "n", "copies",
            F.coalesce("component", "rep").alias("class_id"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
        )
    )
    return signed.select("did", "d1", "d2", "n").join(named, ["d1", "d2", "n"]).select(
        "did", "class_id", "n_links", F.col("copies").alias("n_copies")
    )


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links and n_copies of every document; class_id is the doc_id of the first of its class."""
    rows, names = numbered_documents(docs)
    found = similar_texts(rows)
    if names is None:
        return found.withColumnRenamed("did", "doc_id")
    first = names.select(F.col("did").alias("class_id"), F.col("doc_id").alias("first_id"))
    return found.join(names, "did").join(first, "class_id").select("doc_id", F.col("first_id").alias("class_id"), "n_links", "n_copies")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The documents, all columns, that are the first of their connected group.

    Rows that repeat a kept doc_id with the same text are copies too: one stays.
    """
    rows, _ = numbered_documents(docs)
    kept = similar_texts(rows).where("did = class_id").select(F.col("did").alias("__kept")).distinct()
    joined = rows.join(kept, F.col("__did") == F.col("__kept"), "left_semi").drop("__did")
    return joined.dropDuplicates(["doc_id", "text"])
