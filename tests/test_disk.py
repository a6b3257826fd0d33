from __future__ import annotations

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from corpusloom import session
from corpusloom.catalog import QUERIES


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {name for name in names if name.startswith("shuffle_") and name.endswith(".data")}


def left_over(spark, before: set[str]) -> set[str]:
    """New shuffle files that stay; executors are told to drop theirs without waiting."""
    for _ in range(50):
        found = shuffle_files(spark) - before
        if not found:
            break
        time.sleep(0.1)
    return found


@pytest.mark.parametrize("keep", [session.pinned, session.written])
def test_written_tables_leave_no_shuffle_files(spark, keep):
    """shuffles of a finished step stayed on disk until the driver collected its garbage."""
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    before = shuffle_files(spark)
    kept = keep(counts)
    assert not left_over(spark, before)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, counts.collect())) == [(k, 143 if k < 6 else 142) for k in range(7)]
    assert spark.conf.get(session.FILE_CLEANUP) == "false"
    # The frame that was written may be written or read again.
    assert keep(counts).count() == counts.count() == 7


def test_generated_claims_keep_little_on_disk(spark, folder):
    """children, replies and merged claims are written compressed, and what shuffled them goes."""
    before = shuffle_files(spark)
    claims = QUERIES["wiki_generate_claims"](spark, folder)
    assert not left_over(spark, before)
    assert "Scan ExistingRDD" not in claims._jdf.queryExecution().executedPlan().toString()


def test_page_model_reads_what_was_written(spark, folder):
    """checked sources were computed three times and claims twice within the last step, with all their shuffles."""
    before = shuffle_files(spark)
    model = QUERIES["wiki_page_model"](spark, folder)
    plan = model._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2(cast(content" not in plan and "documents.parquet" not in model._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan
    assert not left_over(spark, before)


def test_only_equal_digests_are_valid(spark):
    """Digests are compared as bytes: what is no digest in lower case stays different from every content."""
    from corpusloom.plans import integrity

    right = hashlib.sha256(b"a").hexdigest()
    recorded = [right, right.upper(), right[:-1], right + "\n", "", None, "stale"]
    sources = spark.createDataFrame(
        [(i, "d", "d-v1", "child", 1, x) for i, x in enumerate(recorded)],
        "claim_id int, doc_id string, version_id string, chunk_kind string, chunk_ordinal int, content_sha256 string",
    )
    documents = spark.createDataFrame([("d", False, "ready", "d-v1")], "doc_id string, deleted boolean, status string, active_version_id string")
    chunks = spark.createDataFrame([("d-v1", "child", 1, "x", "a")], "version_id string, kind string, ordinal int, chunk_id string, content string")
    checked = integrity.source_validity(sources, documents, chunks)
    assert {r.claim_id: r.valid for r in checked.collect()} == {i: i == 0 for i in range(len(recorded))}
    assert {r.claim_id: r.content_sha256 for r in checked.collect()} == dict(enumerate(recorded))


def test_postings_meet_their_terms_in_place(spark, folder, tmp_path):
    """all postings were shuffled by term and again by chunk, above what the index build had left behind."""
    from corpusloom.sources import search_index, tables

    before = shuffle_files(spark)
    indexed = (F.col("kind") == "child") & (F.col("version_status") == "ready")
    index = search_index.build(tables.chunks(spark, folder), indexed, str(tmp_path / "index"))
    index.table("postings")
    assert not left_over(spark, before)
    chunks = index.counted.select("chunk_no", "chunk_id")
    plain = index.table("postings").drop("salt").join(index.table("terms").select("term", "df"), "term").join(chunks, "chunk_no")
    want = sorted(map(str, plain.select(sorted(plain.columns)).collect()))
    assert want
    n = index.n_postings()
    for broadcast_rows in (1, 50, n, 2 * n):  # no term is frequent, some are, all but single ones, all
        got = index.described_postings(broadcast_rows)
        assert sorted(map(str, got.select(sorted(plain.columns)).collect())) == want
