"""Sections and parent/child chunks, computed inside each row: no shuffle moves the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

CHILD_CHARACTERS = 1200


def line_sections(text: Column, heading_path: Column) -> Column:
    """One section per non-blank line, numbered from 0, all under the same headings."""
    lines = F.filter(
        F.transform(F.split(text, "\n"), lambda line: T.strip(line)), lambda line: line != ""
    )
    return F.transform(
        lines,
        lambda line, no: F.struct(
            no.alias("section_no"), heading_path.alias("heading_path"), line.alias("text")
        ),
    )


def whole_text_section(text: Column) -> Column:
    """Plain-text form: the trimmed file is one section without headings, blank files have none."""
    body = T.strip(text)
    section = F.struct(
        F.lit(0).alias("section_no"),
        F.array().cast("array<string>").alias("heading_path"),
        body.alias("text"),
    )
    return F.filter(F.array(section), lambda s: s["text"] != "")


def chunk_rows(
    df: DataFrame, sections: str = "sections", child_characters: int = CHILD_CHARACTERS
) -> DataFrame:
    """Explode sections into parents and fixed-size children with one ordinal sequence.

    The position in the flattened array is the ordinal, so numbering needs no window. Children are
    cut by one linear regex pass per section; their concatenation is the parent.
    """
    if child_characters <= 0:
        raise ValueError("child_characters must be positive")
    window = F.lit("(?s).{1,%d}" % child_characters)

    def pieces(section: Column) -> Column:
        body = section["text"]
        parts = F.concat(F.array(body), F.regexp_extract_all(body, window, F.lit(0)))
        return F.transform(
            parts,
            lambda part, no: F.struct(
                section["section_no"].alias("section_no"),
                section["heading_path"].alias("heading_path"),
                no.alias("child_no"),
                part.alias("content"),
            ),
        )

    keep = [c for c in df.columns if c != sections]
    flat = df.select(
        *keep, F.posexplode(F.flatten(F.transform(F.col(sections), pieces))).alias("ordinal", "p")
    )
    child = F.col("p.child_no") > 0
    start = F.when(child, (F.col("p.child_no") - 1) * child_characters).otherwise(0)
    return flat.select(
        *keep,
        "ordinal",
        F.when(child, F.lit("child")).otherwise(F.lit("parent")).alias("kind"),
        F.when(child, F.col("ordinal") - F.col("p.child_no")).alias("parent_ordinal"),
        F.col("p.section_no").alias("section_no"),
        F.col("p.child_no").alias("child_no"),
        F.col("p.heading_path").alias("heading_path"),
        F.col("p.content").alias("content"),
        F.when(child, T.embedding_text(F.col("p.heading_path"), F.col("p.content"))).alias(
            "embedding_text"
        ),
        start.alias("char_start"),
        (start + F.length("p.content")).alias("char_end"),
        T.token_estimate(F.col("p.content")).alias("token_count"),
    )


def chunk_id(version_id: Column, kind: Column | str, ordinal: Column) -> Column:
    """Deterministic chunk id: digest of version, kind and ordinal."""
    kind_column = F.lit(kind) if isinstance(kind, str) else kind
    natural = F.concat_ws("|", version_id, kind_column, ordinal.cast("string"))
    return F.substring(F.sha2(natural, 256), 1, 32)


def with_chunk_ids(chunks: DataFrame) -> DataFrame:
    """Add `chunk_id` and, for children, `parent_chunk_id`."""
    version = F.col("version_id")
    return chunks.withColumns(
        {
            "chunk_id": chunk_id(version, F.col("kind"), F.col("ordinal")),
            "parent_chunk_id": F.when(
                F.col("kind") == "child", chunk_id(version, "parent", F.col("parent_ordinal"))
            ),
        }
    )
