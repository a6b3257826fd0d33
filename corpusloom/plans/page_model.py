"""The read model of wiki pages: claims that hold their sources, nested twice, in parts of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ordering import number_rows
from corpusloom.plans.integrity import displayed_trust
from corpusloom.session import written

PART_SOURCES = 50
PART_CLAIMS = 50


def source_parts(checked: DataFrame, size: int = PART_SOURCES) -> DataFrame:
    """(claim_id, source_part, sources): the sources of each claim in locator order, `size` to an array.

    `checked` is (claim_id, doc_id, version_id, chunk_id, chunk_ordinal, valid). Places come from range blocks, so a
    claim that cites a third of all chunks becomes many arrays and is never sorted or gathered in one task.
    """
    fields = ["doc_id", "version_id", "chunk_ordinal", "chunk_id"]
    numbered = number_rows(checked.select("claim_id", *fields, "valid"), ["claim_id"], fields, into="no")
    part = F.floor((F.col("no") - 1) / size)
    rows = F.array_sort(F.collect_list(F.struct("no", *fields, "valid")))
    grouped = numbered.groupBy("claim_id", part.alias("source_part")).agg(rows.alias("sources"))
    return grouped.withColumn("sources", F.transform("sources", lambda s: s.dropFields("no")))


def page_model(
    pages: DataFrame, claims: DataFrame, checked: DataFrame, part_claims: int = PART_CLAIMS, part_sources: int = PART_SOURCES
) -> DataFrame:
    """(page_id, slug, title, part_no, claims): each page's claims by position, `part_claims` entries to a row.

    An entry is a claim with its shown trust state and reason, the number of its sources and up to `part_sources` of
    them; a claim with more sources follows in further entries with a higher `source_part`. A page without claims has
    one row with an empty array. Only ids are numbered; texts and sources meet their place by an equi join.
    What several steps read is written once, so chunks are cut and compared once and no step holds the shuffles of others.
    """
    pages = written(pages.select("page_id", "slug", "title"))
    checked = written(checked.select("claim_id", "doc_id", "version_id", "chunk_id", "chunk_ordinal", "valid"))
    shown = written(displayed_trust(claims, checked).join(pages.select("page_id"), "page_id", "left_semi"))
    parts = written(source_parts(checked, part_sources))
    part = F.coalesce("source_part", F.lit(0).cast("long"))
    places = (
        shown.select("page_id", "claim_id", "position")
        .join(parts.select("claim_id", "source_part"), "claim_id", "left")
        .withColumn("source_part", part)
    )
    numbered = number_rows(places, ["page_id"], ["position", "claim_id", "source_part"], into="no").drop("page_id", "position")
    none = F.array().cast(parts.schema["sources"].dataType)
    entries = (
        numbered.join(shown, "claim_id")
        .join(parts, ["claim_id", "source_part"], "left")
        .withColumn("sources", F.coalesce("sources", none))
    )
    entry = F.struct(
        "no",
        "claim_id",
        "text",
        "position",
        "claim_type",
        F.col("displayed").alias("trust_state"),
        F.col("display_reason").alias("reason"),
        "n_sources",
        "source_part",
        "sources",
    )
    grouped = entries.groupBy("page_id", F.floor((F.col("no") - 1) / part_claims).alias("part_no")).agg(
        F.array_sort(F.collect_list(entry), lambda a, b: (a["no"] - b["no"]).cast("int")).alias("claims")
    )
    trimmed = grouped.withColumn("claims", F.transform("claims", lambda c: c.dropFields("no")))
    rows = pages.select("page_id", "slug", "title").join(trimmed, "page_id", "left")
    empty = F.array().cast(trimmed.schema["claims"].dataType)
    return rows.withColumns({"part_no": F.coalesce("part_no", F.lit(0).cast("long")), "claims": F.coalesce("claims", empty)})
