"""Provenance checks: source validity, displayed trust, invalidation, constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.session import broadcast_if_small, pinned

SHORT_ROWS = 500_000  # rows of one or two short ids that may be sent to every task


def packed_digest(digest: Column) -> Column:
    """The bytes of a hexadecimal SHA-256 in lower case, half as long to move; null for anything else, which no content has."""
    return F.when(F.rlike(digest, F.lit("^[0-9a-f]{64}$")) & (F.length(digest) == 64), F.unhex(digest))


def chunk_digests(chunks: DataFrame) -> DataFrame:
    """Locators with the digest of their content; the text itself is not moved."""
    return chunks.select(
        F.col("version_id"),
        F.col("kind").alias("chunk_kind"),
        F.col("ordinal").alias("chunk_ordinal"),
        F.col("chunk_id").alias("current_chunk_id"),
        F.unhex(T.sha256_hex(F.col("content"))).alias("current_sha256"),
    )


def source_validity(sources: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add `valid` to claim sources: the document is live, ready and on that version, and the chunk
    at the locator still has the recorded digest."""
    state = documents.where(~F.col("deleted") & (F.col("status") == "ready")).select(
        "doc_id", F.col("active_version_id").alias("live_version")
    )
    located = sources.withColumn("recorded_sha256", packed_digest(F.col("content_sha256"))).join(
        chunk_digests(chunks), ["version_id", "chunk_kind", "chunk_ordinal"], "left"
    ).join(state, "doc_id", "left")
    valid = (F.col("live_version") == F.col("version_id")) & (
        F.col("current_sha256") == F.col("recorded_sha256")
    )
    return located.withColumn("valid", F.coalesce(valid, F.lit(False))).drop(
        "live_version", "current_sha256", "recorded_sha256", "current_chunk_id"
    )


def narrowed_validity(sources: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """`source_validity` of a part of the sources: only chunks of the versions they name are digested and moved."""
    named = pinned(sources)
    versions = broadcast_if_small(named.select("version_id").distinct(), SHORT_ROWS)
    return source_validity(named, documents, chunks.join(versions, "version_id", "left_semi"))


def displayed_trust(claims: DataFrame, checked: DataFrame) -> DataFrame:
    """Claims as shown on a page: verified only with sources of which every one is valid."""
    rolled = checked.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("n_sources"), F.count_if("valid").alias("n_valid")
    )
    trusted = F.coalesce(
        (F.col("trust_state") == "verified") & (F.col("n_sources") == F.col("n_valid")), F.lit(False)
    )
    zero = F.lit(0).cast("long")
    stored = F.col("reason") if "reason" in claims.columns else F.lit(None).cast("string")
    return claims.join(rolled, "claim_id", "left").withColumns(
        {
            "n_sources": F.coalesce("n_sources", zero),
            "n_valid": F.coalesce("n_valid", zero),
            "displayed": F.when(trusted, "verified").otherwise("needs_review"),
            "display_reason": F.when(trusted, stored).otherwise(
                F.coalesce(stored, F.lit("source_not_current"))
            ),
        }
    )


def admissible_claims(claims: DataFrame, checked: DataFrame) -> DataFrame:
    """Claims a search may return: verified with at least one valid source."""
    usable = checked.where("valid").select("claim_id").distinct()
    return claims.where("trust_state = 'verified'").join(usable, "claim_id", "left_semi")


def invalidate_claims(claims: DataFrame, sources: DataFrame, changed: DataFrame) -> DataFrame:
    """Verified claims citing a replaced or deleted document (doc_id) fall back to review."""
    hit = sources.join(changed.select("doc_id").distinct(), "doc_id", "left_semi").select("claim_id").distinct()
    marked = claims.join(hit.withColumn("hit", F.lit(True)), "claim_id", "left")
    fall = (F.col("trust_state") == "verified") & F.col("hit").isNotNull()
    return marked.withColumns(
        {
            "reason": F.when(fall, "source_not_current"),
            "trust_state": F.when(fall, "needs_review").otherwise(F.col("trust_state")),
        }
    ).drop("hit")


def unique_violations(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """(constraint, value, n) for keys that occur more than once."""
    value = F.concat_ws("|", *(F.col(c).cast("string") for c in key))
    return (
        df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .select(F.lit(name).alias("constraint_name"), "value", "n")
    )


def allowed_violations(df: DataFrame, column: str, allowed: tuple[str, ...], name: str) -> DataFrame:
    """(constraint, value, n) for values outside the allowed set."""
    return (
        df.where(~F.col(column).isin(*allowed) | F.col(column).isNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(name).alias("constraint_name"), "value", "n")
    )


def constraint_report(parts: list[DataFrame]) -> DataFrame:
    """All violations of several constraints as one table."""
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def current_evidence(
    pages: DataFrame, claims: DataFrame, sources: DataFrame, documents: DataFrame, chunks: DataFrame
) -> DataFrame:
    """Valid sources of verified claims on searchable pages.

    (page_id, kb_id, claim_id, text, position, claim_type, chunk_id, doc_id): the page is live in
    an enabled base with its wiki on, the document belongs to the same base.

    Only the claims of such pages, their sources and the chunks of the versions these name are compared; the rest goes
    first, so that neither side of the comparison is shuffled whole.
    """
    shown = broadcast_if_small(pages.where("enabled AND wiki_enabled").select("page_id", "kb_id"), SHORT_ROWS)
    own = claims.join(shown, "page_id", "left_semi")
    facts = pinned(
        own.where("trust_state = 'verified'")
        .select("claim_id", "page_id", "text", "position", "claim_type")
        .join(shown, "page_id")
    )
    homes = documents.select("doc_id", "kb_id")
    asked = broadcast_if_small(facts.select("claim_id", "kb_id").distinct(), SHORT_ROWS)
    named = sources.join(asked, "claim_id").join(homes, ["doc_id", "kb_id"])
    valid = narrowed_validity(named, documents, chunks).where("valid")
    return facts.join(valid.select("claim_id", "kb_id", "doc_id", "chunk_id"), ["claim_id", "kb_id"])
