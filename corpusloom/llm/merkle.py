"""Merkle manifest of a dataset: digests of rows, a tree for each source, a tree over the sources, checked proofs.

A leaf is the SHA-256 of a row's fields, each `-` if null, else its UTF-8 byte count, a colon and the value. The
leaves of a source stand in the order of doc_id; every `FANOUT` consecutive nodes have the digest of their joined
hex digests as parent until one is left, the subroot. The subroots, in the order of the sources (null first), have
the root in the same way.

Per level, lag and lead columns of fixed offsets, masked by a node's slot and the length of its run, are its
siblings; the first node of each run hashes the parent. A window holds one run, never a source: places come from
range blocks with offsets, so a source with a third of all rows is spread over all tasks. Texts are read once, where
they lie; what is shuffled are digests, and the siblings above a leaf travel once for its run.

Null ids come first in their source; rows of equal ids are ordered by their digests, and rows that are equal in all
fields have equal digests, so their order does not show. A null id is not tampered with. Null and empty texts and
sources are different things (`-` and `0:`). Other columns are not read. No rows make no tree and no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tables import stored
from corpusloom.operators.ordering import number_rows

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def row_digest(**changed: Column) -> Column:
    """Digest of the fields, with the values of `changed` in place of the columns of these names."""
    values = [changed.get(name, F.col(name)).cast("string") for name in FIELDS]
    return hashed(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values))


def tampered_text() -> Column:
    """The text, its capitals A to Z made small where 5 divides the CRC of the decimal doc_id."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(chosen, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Nodes (grp, pos, digest) with run, slot, siblings left and right of them, and top: alone in its group."""
    run = "(partition by grp, run"
    before = [f"if(slot >= {k}, lag(digest, {k}) over {run} order by pos), null)" for k in reversed(range(1, FANOUT))]
    after = [f"if(slot + {k} < length, lead(digest, {k}) over {run} order by pos), null)" for k in range(1, FANOUT)]
    placed = nodes.selectExpr("*", f"pos div {FANOUT} as run", f"pos % {FANOUT} as slot")
    sized = placed.selectExpr("*", f"count(1) over {run}) as length")
    # Only a group of one node has a first run of length one.
    return sized.selectExpr(
        *placed.columns,
        f"concat_ws('', {', '.join(before)}) as left",
        f"concat_ws('', {', '.join(after)}) as right",
        "pos = 0 and length = 1 as top",
    )


def heads_of(level: DataFrame) -> DataFrame:
    """One row a run: the parent's place and digest, or a lone node's own with `top` set."""
    parent = F.when(F.col("top"), F.col("digest")).otherwise(hashed(F.col("digest"), F.col("right")))
    return stored(level.where("slot = 0").select("grp", F.col("run").alias("pos"), "top", parent.alias("digest")))


def climb(leaves: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """All levels with siblings, and of each level the heads of its runs; the last heads are all tops.

    The first level is not written: its siblings are fifteen digests a leaf.
    """
    levels, heads = [with_siblings(leaves)], []
    while True:
        heads.append(heads_of(levels[-1]))
        parents = heads[-1].where("not top").drop("top")
        if parents.isEmpty():
            return levels, heads
        levels.append(stored(with_siblings(parents)))


def roots(heads: list[DataFrame]) -> DataFrame:
    """(grp, digest) of every group's last node."""
    return reduce(DataFrame.unionByName, [h.where("top").select("grp", "digest") for h in heads])


def above(levels: list[DataFrame], heads: list[DataFrame], ends: DataFrame) -> DataFrame:
    """For each run of leaves (grp, run) the subroot and the siblings on the way from its parent to the root.

    `ends` holds (grp, subroot, path) with the way from the group's root on. From the last level down, a node's way
    is its siblings and then its parent's way.
    """
    ways = None
    for j in reversed(range(len(levels))):
        lone = heads[j].where("top").join(ends, "grp").select("grp", F.col("pos").alias("run"), "subroot", "path")
        if ways is None:
            ways = lone  # the last heads are all tops
        else:
            parents = ways_of(levels[j + 1], ways).select("grp", F.col("pos").alias("run"), "subroot", "path")
            ways = stored(parents.unionByName(lone))
    return ways


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of `docs`.

    folded_root is the root that the siblings give together with the digest of the tampered row.
    """
    known = F.col("source").isNotNull()
    rows = docs.select(
        F.when(known, F.concat(F.lit("1"), F.col("source"))).otherwise(F.lit("0")).alias("grp"),
        "doc_id",
        row_digest().alias("digest"),
        row_digest(text=tampered_text()).alias("changed"),
        F.monotonically_increasing_id().alias("at"),
    )
    # Written before the range borders are sampled, so that texts are read and hashed once.
    numbered = number_rows(stored(rows), ["grp"], ["doc_id", "digest", "at"], into="pos").withColumn("pos", F.col("pos") - 1).drop("at")
    levels, heads = climb(numbered)
    subroots = roots(heads).withColumn("all", F.lit(""))
    sources = number_rows(subroots, ["all"], ["grp"], into="pos").select(
        F.col("all").alias("grp"), (F.col("pos") - 1).alias("pos"), "digest", F.col("grp").alias("source_grp")
    )
    tree, tree_heads = climb(sources)
    root = roots(tree_heads).first()  # one digest, or none without rows
    start = roots(tree_heads).select("grp", F.col("digest").alias("subroot"), F.expr("cast(array() as array<struct<left:string,right:string>>)").alias("path"))
    ends = ways_of(tree[0], above(tree, tree_heads, start)).select(F.col("source_grp").alias("grp"), F.col("digest").alias("subroot"), "path")
    leaves = ways_of(levels[0], above(levels, heads, stored(ends)))
    joined = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = F.aggregate("path", F.col("changed"), lambda below, s: hashed(s["left"], below, s["right"]))
    expected = F.lit(root["digest"] if root else None).cast("string")
    return leaves.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        expected.alias("root"),
        hashed(joined).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def ways_of(leaves: DataFrame, ways: DataFrame) -> DataFrame:
    """Leaves with the whole way from their own siblings to the root."""
    path = F.when(F.col("top"), F.col("path")).otherwise(F.concat(F.array(F.struct("left", "right")), "path"))
    return leaves.join(ways, ["grp", "run"]).withColumn("path", path)
