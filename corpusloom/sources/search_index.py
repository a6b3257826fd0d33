"""The written search index: chunks with their term counts, postings, and term and base statistics.

| table | rows |
| --- | --- |
| `chunks` | every chunk with its text and a number, without the text to embed, which follows from path and text; indexed children also carry `terms` (term, tf) and `length` |
| `postings` | (term, salt, chunk_no, kb_id, tf, length), range-partitioned by term, salt and chunk, sorted; written when first read |
| `term_stats` | (kb_id, term, df, cf) |
| `terms` | (term, df, salts, peak): the largest weight a chunk can get from the term |
| `sizes` | (kb_id, n_chunks, total_length) |

The corpus is tokenised once: a batch of folded chunks is cut into tokens and counted together, so no shuffle is needed and
no token travels to Python and back.
A term with more than `SALT_ROWS` postings is dealt over `salts` parts, so neither a file nor a join task holds all
postings of a stop word.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from corpusloom.functions import text as T
from corpusloom.operators import bm25
from corpusloom.session import BROADCAST_ROWS, broadcast_if_small, checkpoint_root, shuffles_released
from corpusloom.sources import tables

SALT_ROWS = 1_000_000
TASK_POSTINGS = 2_000_000
TABLES = ("chunks", "postings", "term_stats", "terms", "sizes")


@dataclass(frozen=True)
class SearchIndex:
    """Scans of a written index."""

    spark: SparkSession
    root: str
    salt_rows: int = SALT_ROWS
    late: set[str] = field(default_factory=lambda: {"postings"}, compare=False)  # tables not written yet

    def table(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise ValueError("unknown_index_table")
        if name in self.late:
            with shuffles_released(self.spark):
                self._write_postings()
            self.late.discard(name)
        return self.spark.read.parquet(f"{self.root}/{name}")

    def _write_postings(self) -> None:
        """The postings from the counted chunks. Searches that scan those never need them."""
        rows = self.counted.select("chunk_no", "kb_id", "length", F.inline("terms"))
        # Terms above the limit are at most one in `salt_rows` of all postings.
        frequent = broadcast_if_small(self.table("terms").where("salts > 1").select("term", "salts"))
        salt = F.pmod(F.xxhash64("chunk_no"), F.coalesce("salts", F.lit(1))).cast("int")
        dealt = rows.join(frequent, "term", "left").withColumn("salt", salt)
        postings = dealt.select("term", "salt", "chunk_no", "kb_id", "tf", "length")
        key = ["term", "salt", "chunk_no"]
        sorted_rows = postings.repartitionByRange(self.posting_tasks(), *key).sortWithinPartitions(*key)
        sorted_rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/postings")

    def n_postings(self) -> int:
        return self.table("terms").agg(F.sum("df")).first()[0] or 0

    def posting_tasks(self) -> int:
        """The session's shuffle partitions, or more of them where a task would get too many postings to sort in memory."""
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.n_postings() // TASK_POSTINGS))

    def described_postings(self, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
        """The postings with the frequency of their term and the id of their chunk.

        The terms that more than one in `broadcast_rows` postings have, and with them most postings, meet their frequency
        in place; only postings of the others are shuffled by term. All are shuffled once by chunk and not sorted.
        """
        rows, terms = self.table("postings"), self.table("terms").select("term", "df")
        bound = self.n_postings() / broadcast_rows
        frequent = F.broadcast(terms.where(F.col("df") > bound))
        rare = rows.join(frequent.select("term"), "term", "left_anti").join(terms.where(F.col("df") <= bound), "term")
        met = rows.join(frequent, "term").unionByName(rare).drop("salt")
        tasks = self.posting_tasks()
        chunks = self.counted.select("chunk_no", "chunk_id").repartition(tasks, "chunk_no")
        return met.repartition(tasks, "chunk_no").join(chunks.hint("shuffle_hash"), "chunk_no")

    @property
    def chunks(self) -> DataFrame:
        return self.table("chunks").drop("chunk_no", "terms", "length")

    @property
    def counted(self) -> DataFrame:
        """(chunk_no, chunk_id, kb_id, length, terms) of the indexed children: no text is read."""
        return self.table("chunks").where("length IS NOT NULL").select("chunk_no", "chunk_id", "kb_id", "length", "terms")


COUNTS = ArrayType(StructType([StructField("term", StringType()), StructField("tf", IntegerType())]))
WORD_BYTES = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(text number, token) of the `T.TOKEN` matches in folded texts, in order, from their UTF-8 bytes.

    A run of ASCII letters and digits is a token, and so is each character from U+3400 to U+9FFF: three bytes, the
    first from E3 90 to E9.
    """
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(texts) else np.zeros(0, np.uint8)
    ends = ends - ends[0] if len(texts) else np.zeros(1, np.int64)
    word = WORD_BYTES[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    firsts = ends[:-1][ends[:-1] < ends[1:]]
    begins[firsts] = word[firsts]  # a word does not run over from the text before
    held = word
    if len(data) and data.max() >= 0xE3:
        wide = np.flatnonzero((data >= 0xE3) & (data <= 0xE9))
        wide = wide[(data[wide] > 0xE3) | (data[np.minimum(wide + 1, len(data) - 1)] >= 0x90)]
        begins[wide] = True
        for step in range(3):
            held[wide + step] = True
    starts = np.flatnonzero(begins)
    kept = np.cumsum(held)
    offsets = np.append(kept[starts] - 1, kept[-1] if len(kept) else 0).astype(np.int64)
    body = pa.py_buffer(data[held].tobytes())
    tokens = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), body)
    return np.searchsorted(ends, starts, side="right") - 1, tokens


@F.arrow_udf(COUNTS)
def term_counts(texts: pa.Array) -> pa.Array:
    """Array of (term, tf) of each folded text's tokens; null stays null."""
    rows, tokens = tokens_of(texts)
    coded = tokens.dictionary_encode()
    span = max(len(coded.dictionary), 1)
    keys = np.sort(rows * span + coded.indices.to_numpy(zero_copy_only=False))
    firsts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    tf, keys = np.diff(np.append(firsts, len(keys))), keys[firsts]
    ends = np.cumsum(np.bincount(keys // span, minlength=len(texts)))
    words = coded.dictionary.take(pa.array(keys % span)).cast(pa.string())
    counted = pa.StructArray.from_arrays([words, pa.array(tf, pa.int32())], ["term", "tf"])
    offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
    return pa.ListArray.from_arrays(offsets, counted, mask=texts.is_null())


def build(chunks: DataFrame, indexed: Column, root: str, salt_rows: int = SALT_ROWS) -> SearchIndex:
    """Write the index of `chunks`; `indexed` tells which of them are searched."""
    index = SearchIndex(chunks.sparkSession, root, salt_rows)
    with shuffles_released(index.spark):
        _write(index, chunks, indexed)
    return index


def _write(index: SearchIndex, chunks: DataFrame, indexed: Column) -> None:
    root = index.root
    told = chunks.drop("embedding_text").withColumn("terms", term_counts(F.when(indexed, T.fold(F.col("content")))))
    length = F.aggregate("terms", F.lit(0), lambda total, counted: total + counted["tf"])
    # The number is written with the chunk, so it stays what it is however often the table is read.
    told.withColumns({"chunk_no": F.monotonically_increasing_id(), "length": length}).write.option(
        "compression", "zstd"
    ).parquet(f"{root}/chunks")
    counted = index.counted
    counted.groupBy("kb_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("length").cast("long").alias("total_length")
    ).write.parquet(f"{root}/sizes")
    whole = index.table("sizes").agg(F.sum("n_chunks").alias("n"), F.sum("total_length").alias("length")).first()
    average = F.lit(float(whole["length"] / whole["n"]) if whole["length"] else 1.0)
    rows = counted.select("chunk_no", "kb_id", "length", F.inline("terms"))
    weight = bm25.term_weight(F.col("tf"), F.col("length"), average)
    rows.groupBy("kb_id", "term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").cast("long").alias("cf"), F.max(weight).alias("peak")
    ).write.parquet(f"{root}/term_stats")
    known = index.table("term_stats").groupBy("term").agg(F.sum("df").cast("long").alias("df"), F.max("peak").alias("peak"))
    salts = F.ceil(F.col("df") / index.salt_rows).cast("int")
    known.select("term", "df", "peak", salts.alias("salts")).write.parquet(f"{root}/terms")


def _fingerprint(spark: SparkSession, folder: str) -> str:
    """Changes with the files of the documents, so a changed folder gets a new index."""
    files = spark.read.parquet(f"{folder}/documents.parquet").select(
        "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time"
    )
    rows = sorted(map(str, files.distinct().collect()))
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()


_built: dict[tuple, SearchIndex] = {}


def of(spark: SparkSession, folder: str) -> SearchIndex:
    """The index of a folder's documents, built by the first query of a session that needs it."""
    key = (spark.sparkContext.applicationId, folder, _fingerprint(spark, folder))
    if key not in _built:
        root = f"{checkpoint_root(spark)}/search-index-{uuid.uuid4().hex}"
        indexed = (F.col("kind") == "child") & (F.col("version_status") == "ready")
        _built[key] = build(tables.chunks(spark, folder), indexed, root)
    return _built[key]
