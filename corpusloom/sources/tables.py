"""The given tables and the corpus entities derived from them.

Every derived table is a lazy DataFrame over the whole input; nothing is cached or collected.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunking
from corpusloom.schemas import GIVEN

CHILD_CHARACTERS = 200
DISABLED_BASES = ("src7", "src13")
TASK_DOCUMENTS = 4096
AS_OF = "2024-01-31 00:00:00"


Table = Callable[[SparkSession, str], DataFrame]


def plan_once(build: Table) -> Table:
    """Keep the lazy plan of a derived table per session and folder; no data is cached."""
    plans: dict[tuple, DataFrame] = {}

    @wraps(build)
    def table(spark: SparkSession, folder: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, id(spark), folder)
        if key not in plans:
            plans[key] = build(spark, folder)
        return plans[key]

    return table


# Tables with long rows: a file of one row group is spread before the text work starts.
LONG_ROWS = {"documents": "doc_id", "pages": "page_id", "embeddings": "vec_id"}


def read(spark: SparkSession, folder: str, table: str, spread: bool = False) -> DataFrame:
    """Scan a given table with its declared schema.

    `spread` hashes the rows over all cores when the input has fewer splits than cores, which only
    small inputs have; a large table is read as it is split on disk.
    """
    df = spark.read.schema(GIVEN[table]).parquet(f"{folder}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, LONG_ROWS[table])
    return df


def by_document(df: DataFrame, documents: int) -> DataFrame:
    """Rows dealt by doc_id over the session's shuffle partitions, or more of them where a task would get too many documents."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(usual, -(-documents // TASK_DOCUMENTS)), "doc_id")


def read_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A given table as a file stream, whether it is one file or a folder of part files."""
    # The pattern names this table only; a file stream accepts one file no other way.
    return spark.readStream.schema(GIVEN[table]).parquet(f"{folder}/{table}.parque[t]")


def as_of() -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{AS_OF}'")


def base_flags(kb_id: Column) -> dict[str, Column]:
    return {
        "enabled": ~kb_id.isin(*DISABLED_BASES),
        "wiki_enabled": F.substring(kb_id, 4, 9).cast("int") % 2 == 0,
    }


@plan_once
def knowledge_bases(spark: SparkSession, folder: str) -> DataFrame:
    bases = read(spark, folder, "documents").select(F.col("source").alias("kb_id")).distinct()
    return bases.withColumns(base_flags(F.col("kb_id")))


def _version_id(version_no: Column) -> Column:
    return F.concat(F.col("doc_id").cast("string"), F.lit("-v"), version_no.cast("string"))


def _has_second(doc_id: Column) -> Column:
    return doc_id % 13 == 0


def _failed(doc_id: Column) -> Column:
    return doc_id % 17 == 0


@plan_once
def documents_dim(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without their text: base, names, status, active version, deletion mark."""
    docs = read(spark, folder, "documents").select("doc_id", "source", "lang")
    labels = read(spark, folder, "labels").select("doc_id", "toxic")
    doc = F.col("doc_id")
    title = F.concat(F.lit("doc-"), doc.cast("string"))
    latest = F.when(_has_second(doc), F.lit(2)).otherwise(F.lit(1))
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.col("source").alias("kb_id"),
        "lang",
        title.alias("title"),
        F.concat(title, F.lit(".txt")).alias("filename"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("deleted"),
        F.when(_failed(doc), F.lit("failed")).otherwise(F.lit("ready")).alias("status"),
        F.when(~_failed(doc), _version_id(latest)).alias("active_version_id"),
    )


@plan_once
def version_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every version with its text; where two exist, the first one is an older half-length draft."""
    docs = read(spark, folder, "documents", spread=True)
    doc = F.col("doc_id")
    half = F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))

    def entry(no: int, body: Column) -> Column:
        return F.struct(F.lit(no).alias("version_no"), body.alias("text"))

    versions = F.when(_has_second(doc), F.array(entry(1, half), entry(2, F.col("text")))).otherwise(
        F.array(entry(1, F.col("text")))
    )
    exploded = docs.select(
        "doc_id", F.col("source").alias("kb_id"), "lang", F.explode(versions).alias("v")
    )
    number = F.col("v.version_no")
    latest = F.when(_has_second(doc), F.lit(2)).otherwise(F.lit(1))
    return exploded.select(
        "doc_id",
        "kb_id",
        "lang",
        number.alias("version_no"),
        _version_id(number).alias("version_id"),
        F.when(_failed(doc) & (number == latest), F.lit("failed"))
        .otherwise(F.lit("ready"))
        .alias("version_status"),
        F.col("v.text").alias("text"),
    )


@plan_once
def sections(spark: SparkSession, folder: str) -> DataFrame:
    """Versions with their sections as one array per row."""
    headings = F.array("kb_id", "lang")
    return version_texts(spark, folder).select(
        "doc_id",
        "kb_id",
        "version_no",
        "version_id",
        "version_status",
        chunking.line_sections(F.col("text"), headings).alias("sections"),
    )


@plan_once
def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Parents and children of every version."""
    rows = chunking.chunk_rows(sections(spark, folder), child_characters=CHILD_CHARACTERS)
    return chunking.with_chunk_ids(rows)


@plan_once
def children(spark: SparkSession, folder: str) -> DataFrame:
    """What the search index holds: the children of every ready version, retired ones included."""
    return chunks(spark, folder).where((F.col("kind") == "child") & (F.col("version_status") == "ready"))


@plan_once
def queries(spark: SparkSession, folder: str) -> DataFrame:
    """One search query per benchmark passage."""
    return read(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@plan_once
def query_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """One wiki query per sentence of a passage; the sentences of a passage form a case."""
    sentences = F.filter(
        F.transform(F.split("text", r"[.!?]"), lambda s: T.strip(F.replace(s, F.lit("\n"), F.lit(" ")))),
        lambda s: s != "",
    )
    exploded = read(spark, folder, "benchmark").select(
        F.col("item_id").alias("case_id"), F.posexplode(sentences).alias("pos", "text")
    )
    return exploded.select(
        (F.col("case_id") * 100 + F.col("pos")).alias("query_id"), "case_id", "text"
    )


@plan_once
def chunk_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The vector table as an index of its own: ids and bases come from the vectors."""
    return read(spark, folder, "embeddings", spread=True).select(
        F.col("vec_id").alias("chunk_id"),
        F.col("label").alias("kb_id"),
        F.col("embedding").alias("vector"),
    )


@plan_once
def document_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of documents: the vector with the document's number stands at its first child."""
    vectors = read(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    filled = version_texts(spark, folder).where(T.strip(F.col("text")) != "").select("version_id")
    active = documents_dim(spark, folder).withColumnRenamed("active_version_id", "version_id")
    return (
        active.select("doc_id", "kb_id", "version_id")
        .join(vectors, "doc_id")
        .join(filled, "version_id", "left_semi")
        .select(
            chunking.chunk_id(F.col("version_id"), "child", F.lit(1)).alias("chunk_id"),
            "kb_id",
            F.col("embedding").alias("vector"),
        )
    )


@plan_once
def query_vectors(spark: SparkSession, folder: str) -> DataFrame:
    ids = read(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"))
    vectors = read(spark, folder, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")
    )
    return ids.join(vectors, "query_id")
