"""Raw uploads: file scan, validation, plain-text and Markdown/HTML sections."""

from __future__ import annotations

import zipfile
from io import BytesIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from corpusloom.functions import text as T

MAX_BYTES = 50 * 1024 * 1024
# Accepted extensions and the MIME type each must be declared with.
MIME_BY_SUFFIX = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".md": "text/markdown",
    ".txt": "text/plain",
}
# Entries a DOCX container must list.
DOCX_ENTRIES = {"[Content_Types].xml", "word/document.xml"}


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """Whole files of the accepted kinds as rows (path, content, length)."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{pdf,docx,md,txt,PDF,DOCX,MD,TXT}")
        .load(folder)
        .select("path", "content", "length")
    )


@F.pandas_udf(BooleanType())
def _is_docx(contents: pd.Series) -> pd.Series:
    def listed(content: bytes | None) -> bool | None:
        if content is None:
            return None
        try:
            with zipfile.ZipFile(BytesIO(content)) as archive:
                return set(archive.namelist()) >= DOCX_ENTRIES
        except zipfile.BadZipFile:
            return False

    return contents.map(listed)


def validate(uploads: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Add `code` (null when accepted), `suffix`, `mime_type`, `sha256`, `title` and `size`.

    `uploads` has filename, declared_mime and binary content. The first failing check names the
    code. Only .docx contents reach Python, for the container listing.
    """
    content, suffix = F.col("content"), T.file_suffix(F.col("filename"))
    expected = F.lit(None).cast("string")
    for name, mime in MIME_BY_SUFFIX.items():
        expected = F.when(suffix == name, mime).otherwise(expected)
    declared = F.lower(T.strip(F.element_at(F.split("declared_mime", ";"), 1)))
    size = F.length(content)
    docx = F.coalesce(_is_docx(F.when(suffix == ".docx", content)), F.lit(False))
    as_text = content.cast("string")
    code = (
        F.when(expected.isNull(), "unsupported_file_type")
        .when(F.coalesce(declared != expected, F.lit(True)), "unsupported_media_type")
        .when(size == 0, "empty_file")
        .when(size > max_bytes, "file_too_large")
        .when((suffix == ".pdf") & (F.substring(content, 1, 5) != F.lit(b"%PDF-")), "invalid_file_signature")
        .when((suffix == ".docx") & ~docx, "invalid_file_signature")
        .when(suffix.isin(".md", ".txt") & ~F.is_valid_utf8(as_text), "invalid_text_encoding")
    )
    checked = uploads.withColumn("code", code)
    accepted = F.col("code").isNull()
    return checked.withColumns(
        {
            "suffix": F.when(accepted, suffix),
            "mime_type": F.when(accepted, expected),
            "sha256": F.when(accepted, F.sha2(content, 256)),
            "title": F.when(accepted, T.title_of(F.col("filename"))),
            "size": F.when(accepted, size.cast("long")),
        }
    )


_HEADING = "\x02"
_BLOCK_TAGS = "p|br|div|li|ul|ol|tr|table|article|section|nav|header|footer|blockquote|pre|body"


def html_to_marked(html: Column) -> Column:
    """HTML as lines of text; a heading line starts with a control mark and its level."""
    out = F.regexp_replace(html, r"(?is)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?is)<(?:script|style|head)\b.*?</(?:script|style|head)>", "")
    out = F.regexp_replace(out, r"\s+", " ")
    out = F.regexp_replace(out, r"(?i)<h([1-6])\b[^>]*>", "\n" + _HEADING + "$1")
    out = F.regexp_replace(out, r"(?i)</h[1-6]>", "\n")
    out = F.regexp_replace(out, r"(?i)</?(?:" + _BLOCK_TAGS + r")\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def markdown_to_marked(text: Column) -> Column:
    """Markdown with its ATX headings marked; a leading front-matter block is dropped."""
    body = F.regexp_replace(text, r"(?s)\A---\r?\n.*?\r?\n---\r?\n", "")
    lines = F.transform(
        F.split(body, r"\r?\n"),
        lambda line: F.regexp_replace(
            F.regexp_replace(line, r"^ {0,3}#{6}\s+(.*?)\s*#*\s*$", _HEADING + "6$1"),
            r"^ {0,3}(#{1,5})\s+(.*?)\s*#*\s*$",
            _HEADING + "$1 $2",
        ),
    )
    levels = {"#" * n + " ": str(n) for n in range(5, 0, -1)}
    joined = F.array_join(lines, "\n")
    for marks, level in levels.items():
        joined = F.replace(joined, F.lit(_HEADING + marks), F.lit(_HEADING + level))
    return joined


def marked_sections(marked: Column) -> Column:
    """Array of sections: the text under each heading with the trail of headings above it.

    The text is cut at heading marks; a fold over the pieces keeps the current trail and appends
    (trail, body). Blank bodies are dropped, as a heading alone is no section.
    """
    pieces = F.split(marked, "(?m)^" + _HEADING)
    empty_trail = F.array().cast("array<struct<level:int,title:string>>")
    start = F.struct(
        empty_trail.alias("trail"),
        F.array().cast("array<struct<heading_path:array<string>,text:string>>").alias("out"),
    )

    def step(state: Column, piece: Column) -> Column:
        level = F.substring(piece, 1, 1).try_cast("int")
        title = T.strip(F.regexp_extract(piece, r"^[1-6]([^\n]*)", 1))
        above = F.filter(state["trail"], lambda h: h["level"] < level)
        deeper = F.concat(above, F.array(F.struct(level.alias("level"), title.alias("title"))))
        headed = level.isNotNull() & piece.rlike(r"^[1-6]")
        trail = F.when(headed, deeper).otherwise(state["trail"])
        body = T.strip(F.when(headed, F.regexp_replace(piece, r"^[^\n]*\n?", "")).otherwise(piece))
        section = F.struct(
            F.transform(trail, lambda h: h["title"]).alias("heading_path"), body.alias("text")
        )
        return F.struct(trail.alias("trail"), F.concat(state["out"], F.array(section)).alias("out"))

    # The text before the first mark has no level digit of its own.
    first = F.struct(
        F.array().cast("array<string>").alias("heading_path"), T.strip(F.get(pieces, 0)).alias("text")
    )
    rest = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    folded = F.aggregate(rest, start, step, lambda state: state["out"])
    kept = F.filter(F.concat(F.array(first), folded), lambda s: s["text"] != "")
    return F.transform(
        kept,
        lambda s, no: F.struct(
            no.alias("section_no"), s["heading_path"].alias("heading_path"), s["text"].alias("text")
        ),
    )


def html_sections(html: Column) -> Column:
    return marked_sections(html_to_marked(html))


def markdown_sections(text: Column) -> Column:
    return marked_sections(markdown_to_marked(text))


def parse_status(sections: Column) -> Column:
    """A document without any section cannot be parsed."""
    return F.when(F.size(sections) == 0, "document_parse_failed").otherwise("ok")


def section_spans(marked: DataFrame) -> DataFrame:
    """Page span of sections: least and greatest page of their items, null without pages.

    `marked` is (doc_id, section_no, page_no), one row per item.
    """
    return marked.groupBy("doc_id", "section_no").agg(
        F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end")
    )
