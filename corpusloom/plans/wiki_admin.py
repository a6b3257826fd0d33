"""Wiki page versions, reviews, budgets and jobs as table-to-table decisions."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ordering import running_sum
from corpusloom.session import pinned

PIPELINE = "wiki-v1"
FOLD_LIMIT = 100_000
ALIVE_MINUTES = 35


def upsert_pages(proposals: DataFrame, current: DataFrame, versions: DataFrame) -> DataFrame:
    """Decide page proposals against the published state.

    `proposals` is (kb_id, slug, content_digest, metadata_digest); `current` adds page_id, version
    id, digests and origin of the published version; `versions` is (page_id, version_no,
    review_state). Equal content and metadata give no version. After a manual edit or a revert the
    proposal waits for review and older waiting ones are superseded.
    """
    history = versions.groupBy("page_id").agg(
        F.max("version_no").alias("highest"),
        F.count_if(F.col("review_state") == "pending_review").alias("waiting"),
    )
    state = current.select(
        "kb_id",
        "slug",
        "page_id",
        "current_version_id",
        "origin",
        F.col("content_digest").alias("old_content"),
        F.col("metadata_digest").alias("old_metadata"),
    )
    joined = proposals.join(state, ["kb_id", "slug"], "left").join(history, "page_id", "left")
    same = (F.col("content_digest") == F.col("old_content")) & (
        F.col("metadata_digest") == F.col("old_metadata")
    )
    manual = F.col("origin").isin("user", "revert")
    decision = (
        F.when(F.coalesce(same, F.lit(False)), "unchanged")
        .when(F.coalesce(manual, F.lit(False)), "pending_review")
        .otherwise("published")
    )
    return joined.select(
        "kb_id",
        "slug",
        decision.alias("decision"),
        F.when(decision != "unchanged", F.coalesce("highest", F.lit(0)) + 1).cast("long").alias("version_no"),
        F.when(decision == "pending_review", F.col("waiting")).otherwise(F.lit(0)).cast("long").alias("superseded"),
        F.when(decision != "unchanged", F.col("current_version_id")).alias("base_version_id"),
    )


def page_actions(requests: DataFrame, pages: DataFrame, versions: DataFrame) -> DataFrame:
    """Decide edit, revert and review requests with the optimistic base-version check.

    `requests` is (request_id, action edit/revert/publish/reject, page_id, base_version_id,
    target_version_id), one per page; `versions` is (version_id, page_id, version_no,
    review_state, base_published_version_id). A review that is already decided the same way is
    repeated without effect.
    """
    state = pages.select("page_id", "current_version_id")
    target = versions.select(
        F.col("version_id").alias("target_version_id"), "page_id", "review_state", "base_published_version_id"
    ).withColumn("has_target", F.lit(True))
    highest = versions.groupBy("page_id").agg(F.max("version_no").alias("highest"))
    joined = (
        requests.join(state, "page_id", "left")
        .join(target, ["page_id", "target_version_id"], "left")
        .join(highest, "page_id", "left")
    )
    action, base = F.col("action"), F.col("base_version_id")
    review = action.isin("publish", "reject")
    final = F.when(action == "publish", "published").when(action == "reject", "rejected")
    stale = ~F.col("current_version_id").eqNullSafe(base)
    no_target = F.col("has_target").isNull()
    decision = (
        F.when(F.col("current_version_id").isNull(), "wiki_page_not_found")
        .when(~review & stale, "wiki_version_conflict")
        .when((action != "edit") & no_target, "wiki_page_version_not_found")
        .when((action == "revert") & (F.col("target_version_id") == base), "wiki_revert_current_version")
        .when(review & (F.col("review_state") == final), "repeated")
        .when(review & (F.col("review_state") != "pending_review"), "wiki_candidate_not_pending")
        .when(review & (stale | ~F.col("base_published_version_id").eqNullSafe(base)), "wiki_version_conflict")
        .when(action == "edit", "edited")
        .when(action == "revert", "reverted")
        .otherwise(final)
    )
    appended = decision.isin("edited", "reverted")
    published = F.when(decision == "published", F.col("target_version_id"))
    return joined.select(
        "request_id",
        "page_id",
        "action",
        decision.alias("decision"),
        F.when(appended, F.col("highest") + 1).cast("long").alias("new_version_no"),
        F.when(decision == "reverted", F.col("target_version_id")).alias("claims_from_version"),
        published.alias("now_current"),
    )


def copied_claims(decided: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims of the versions appended by page actions.

    A revert copies the target's claims; an edit gets one manual claim without a source.
    """
    reverted = decided.where("decision = 'reverted'").select(
        "page_id", "new_version_no", F.col("claims_from_version").alias("version_id")
    )
    copied = claims.join(reverted, "version_id").select(
        "page_id", "new_version_no", "claim_key", "trust_state", "position", "claim_type"
    )
    manual = decided.where("decision = 'edited'").select(
        "page_id",
        "new_version_no",
        F.lit("manual-content").alias("claim_key"),
        F.lit("needs_review").alias("trust_state"),
        F.lit(0).alias("position"),
        F.lit("manual").alias("claim_type"),
    )
    return copied.unionByName(manual)


def _fold_small(jobs: DataFrame) -> DataFrame:
    schema = "kb_id string, job_id string, admitted boolean"

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["job_order", "job_id"])
        left = int(rows["remaining"].iloc[0])
        taken = []
        for estimate in rows["estimate"]:
            fits = estimate <= left
            left -= int(estimate) if fits else 0
            taken.append(fits)
        return rows[["kb_id", "job_id"]].assign(admitted=taken)

    columns = ["kb_id", "job_order", "job_id", "estimate", "remaining"]
    return jobs.select(*columns).groupBy("kb_id").applyInPandas(fold, schema)


def admit_within_budget(jobs: DataFrame, budgets: DataFrame, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """(kb_id, job_id, admitted): jobs in order, each admitted if it fits into what is left.

    `jobs` is (kb_id, job_order, job_id, estimate > 0), `budgets` is (kb_id, remaining). A job that
    does not fit uses nothing, a later smaller one may still fit. Bases with many undecided jobs
    are worked off in waves: the longest fitting prefix by a running sum over blocks is admitted,
    jobs above the new remainder can never fit any more, the rest goes on. Small bases are folded
    in one task each.
    """
    pending = jobs.join(budgets, "kb_id").select("kb_id", "job_order", "job_id", "estimate", "remaining")
    parts: list[DataFrame] = []
    undecided = pinned(pending)
    while True:
        sizes = undecided.groupBy("kb_id").agg(F.count(F.lit(1)).alias("n"))
        large = sizes.where(F.col("n") > fold_limit).select("kb_id")
        if large.isEmpty():
            parts.append(_fold_small(undecided))
            break
        parts.append(_fold_small(undecided.join(large, "kb_id", "left_anti")))
        waiting = undecided.join(large, "kb_id", "left_semi")
        parts.append(waiting.where("estimate > remaining").select("kb_id", "job_id", F.lit(False).alias("admitted")))
        summed = pinned(
            running_sum(
                waiting.where("estimate <= remaining"), ["kb_id"], ["job_order", "job_id"], "estimate", "used"
            )
        )
        fits = F.col("used") <= F.col("remaining")
        parts.append(summed.where(fits).select("kb_id", "job_id", F.lit(True).alias("admitted")))
        spent = summed.where(fits).groupBy("kb_id").agg(F.max("used").alias("spent"))
        undecided = pinned(
            summed.where(~fits)
            .join(spent, "kb_id")
            .withColumn("remaining", F.col("remaining") - F.col("spent"))
            .drop("used", "spent")
        )
    return reduce(DataFrame.unionByName, parts)


def token_ledger(usage: DataFrame, limits: DataFrame) -> DataFrame:
    """Charges per base, each call key once; a call without a measured count costs its reservation."""
    first = usage.groupBy("call_key").agg(
        F.min_by(F.struct("kb_id", "reserved_tokens", "measured_tokens"), "usage_no").alias("u")
    )
    charged = F.coalesce("u.measured_tokens", "u.reserved_tokens")
    totals = first.groupBy(F.col("u.kb_id").alias("kb_id")).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(charged).alias("tokens_charged"),
        F.sum("u.reserved_tokens").alias("tokens_reserved"),
    )
    return limits.join(totals, "kb_id", "left").select(
        "kb_id",
        F.coalesce("calls", F.lit(0)).cast("long").alias("calls"),
        F.coalesce("tokens_charged", F.lit(0)).cast("long").alias("tokens_charged"),
        F.coalesce("tokens_reserved", F.lit(0)).cast("long").alias("tokens_reserved"),
        (F.col("token_limit") - F.coalesce("tokens_charged", F.lit(0))).cast("long").alias("remaining"),
    )


def update_configs(requests: DataFrame, configs: DataFrame) -> DataFrame:
    """Decide configuration requests (kb_id, enabled, token_limit), null meaning unchanged."""
    joined = requests.select(
        "request_id", "kb_id", F.col("enabled").alias("want"), F.col("token_limit").alias("new_limit")
    ).join(configs, "kb_id", "left")
    was = F.coalesce("enabled", F.lit(False))
    old = F.coalesce("token_limit", F.lit(0))
    used = F.coalesce("tokens_charged", F.lit(0)) + F.coalesce("tokens_reserved", F.lit(0))
    limit = F.coalesce("new_limit", old)
    now = F.coalesce("want", was)
    decision = (
        F.when(F.col("new_limit") < used, "token_limit_below_usage")
        .when(F.coalesce("want", F.lit(False)) & (limit <= 0), "token_limit_required")
        .otherwise("ok")
    )
    ok = decision == "ok"
    return joined.select(
        "request_id",
        "kb_id",
        decision.alias("decision"),
        F.when(ok, now).otherwise(was).alias("enabled"),
        F.when(ok, limit).otherwise(old).cast("long").alias("token_limit"),
        (ok & now & ~was).alias("schedule_documents"),
        (ok & now & (~was | (limit > old))).alias("resume_paused"),
    )


def resumed_jobs(configs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Paused jobs of bases whose configuration change resumes them, back to pending."""
    paused = jobs.where(F.col("status").isin("paused_budget", "paused_disabled"))
    return paused.join(configs.where("resume_paused").select("kb_id"), "kb_id", "left_semi").withColumn(
        "status", F.lit("pending")
    )


def schedule_jobs(documents: DataFrame, configs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Wiki jobs to insert for ready active versions of enabled bases, by idempotency key."""
    ready = documents.where(
        (F.col("status") == "ready") & ~F.col("deleted") & F.col("active_version_id").isNotNull()
    )
    wanted = ready.join(configs.where("enabled").select("kb_id"), "kb_id", "left_semi").select(
        F.concat_ws(":", F.lit("wiki"), "active_version_id", F.lit(PIPELINE)).alias("idempotency_key"),
        "kb_id",
        F.col("active_version_id").alias("version_id"),
    )
    return wanted.join(jobs.select("idempotency_key").distinct(), "idempotency_key", "left_anti")


def admit_jobs(
    jobs: DataFrame, configs: DataFrame, documents: DataFrame, chunk_counts: DataFrame, now: Column
) -> DataFrame:
    """What a worker does with each wiki job when its message arrives, before the budget check."""
    enabled = configs.select("kb_id", F.col("enabled").alias("wiki_on"))
    source = documents.where((F.col("status") == "ready") & ~F.col("deleted")).select(
        F.col("active_version_id").alias("version_id"), F.col("kb_id").alias("source_kb")
    )
    counts = chunk_counts.select("version_id", "n_chunks")
    joined = (
        jobs.join(enabled, "kb_id", "left").join(source, "version_id", "left").join(counts, "version_id", "left")
    )
    status = F.col("status")
    alive = F.col("heartbeat_at") > now - F.expr(f"INTERVAL {ALIVE_MINUTES} MINUTES")
    decision = (
        F.when(~status.isin("pending", "retry_wait", "running"), "skipped")
        .when((status == "retry_wait") & (F.col("next_retry_at") > now), "not_due")
        .when((status == "running") & alive, "alive")
        .when(~F.coalesce("wiki_on", F.lit(False)), "paused_disabled")
        .when(F.col("version_id").isNull(), "wiki_missing_source_version")
        .when(F.coalesce(F.col("source_kb") != F.col("kb_id"), F.lit(True)), "superseded")
        .when(F.coalesce("n_chunks", F.lit(0)) == 0, "wiki_no_source_chunks")
        .when(F.col("has_checkpoint"), "resume_publishing")
        .otherwise("reserve_budget")
    )
    return joined.withColumn("decision", decision)


def job_listing(jobs: DataFrame, usage: DataFrame, limit: int = 50) -> DataFrame:
    """Newest jobs per base with their token usage, null or 0 where there is none."""
    from corpusloom.operators.ordering import top_k

    newest = top_k(jobs, ["kb_id"], [F.desc("created_at"), F.desc("job_id")], limit, into="place")
    spent = usage.select(
        "job_id",
        F.col("measured_tokens").alias("actual_tokens"),
        F.coalesce("measured_tokens", "reserved_tokens").alias("charged_tokens"),
    )
    return newest.join(spent, "job_id", "left").withColumn(
        "charged_tokens", F.coalesce("charged_tokens", F.lit(0))
    )


def list_pages(
    pages: DataFrame, kb_id: str, *, page_type: str | None = None, cursor: str | None = None, limit: int = 50
) -> DataFrame:
    """One keyset page of a base's published pages: slugs after the cursor, in slug order."""
    rows = pages.where((F.col("kb_id") == kb_id) & F.col("current_version_id").isNotNull())
    if page_type is not None:
        rows = rows.where(F.col("page_type") == page_type)
    if cursor is not None:
        rows = rows.where(F.col("slug") > cursor)
    return rows.select("page_id", "kb_id", "slug", "page_type", "title").orderBy("slug").limit(limit)
