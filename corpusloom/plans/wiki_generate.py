"""Generation of grounded wiki facts as one plan: replies, validation, merge across batches, binding to sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import replies
from corpusloom.functions import text as T
from corpusloom.plans import wiki_build
from corpusloom.plugins import generate_replies
from corpusloom.session import pinned, written

PLACES = 100_000  # a reply is one bounded string, so a place in it stays far below


@dataclass(frozen=True)
class Generated:
    """What a generation gives.

    claims (doc_id, version_id, claim_no, text, source_indices), sources (doc_id, version_id, claim_no, source_no,
    chunk_id, ordinal, content_sha256, ...), topics (doc_id, version_id, topic_no, name, aliases, source_indices) and
    outcomes (doc_id, version_id, n_batches, code, measured_tokens); code is null for a version that succeeded.
    """

    claims: DataFrame
    sources: DataFrame
    topics: DataFrame
    outcomes: DataFrame


def _drafts(good: DataFrame, items: Column, **fields: str) -> DataFrame:
    """One row per claim or topic of a reply, placed by batch and place in the reply."""
    exploded = good.select("doc_id", "version_id", "batch", F.posexplode(items).alias("at", "item"))
    named = [F.col(f"item.{source}").alias(name) for name, source in fields.items()]
    return exploded.select("doc_id", "version_id", (F.col("batch") * PLACES + F.col("at")).alias("position"), *named)


def generate(
    children: DataFrame, generator: Callable[[str, list[tuple[int, str]]], tuple[str, int | None]]
) -> Generated:
    """Call the generator for every batch of twelve children and bind what it says.

    `children` is (doc_id, version_id, title, child_index, chunk_id, kind, ordinal, heading_path, content). Every
    reply is checked against the number of children of its version: indices count through the version, not the batch.
    One faulty reply fails its version, with the code of its first faulty batch, and nothing of it is kept. Replies are
    written before they are read for claims, topics and outcomes, so a generator is asked once; merged claims are
    written for those who read them and their sources.
    """
    counts = children.groupBy("version_id").agg(F.count(F.lit(1)).alias("count"))
    said = generate_replies(children, generator).join(counts, "version_id")
    parsed = replies.parsed(F.col("reply"))
    said = written(said.withColumn("code", replies.reply_error(parsed, F.col("count"))).drop("count"))
    wrong = F.col("code").isNotNull()
    outcomes = pinned(
        said.groupBy("doc_id", "version_id").agg(
            F.count(F.lit(1)).alias("n_batches"),
            F.min_by(F.when(wrong, F.col("code")), F.when(wrong, F.col("batch"))).alias("code"),
            wiki_build.strict_total(F.col("measured_tokens")).cast("long").alias("measured_tokens"),
        )
    )
    failed = outcomes.where("code IS NOT NULL").select("version_id")
    good = said.join(failed, "version_id", "left_anti")
    claims = _drafts(good, replies.reply_claims(parsed), text="text", source_indices="source_indices")
    topics = _drafts(good, replies.reply_topics(parsed), name="name", aliases="aliases", source_indices="source_indices")
    # Merging and numbering stay within a version: texts are dealt once, after the key, whose Python would hide that they are.
    keyed = claims.withColumn("merge_key", T.merge_key(F.col("text"))).repartition("doc_id", "version_id")
    merged = written(wiki_build.numbered_claims(wiki_build.merge_claims(keyed)).drop("merge_key"))
    kept = wiki_build.merge_topics(topics)
    return Generated(merged, wiki_build.bind_sources(merged, children), kept, outcomes)


def lead_sentences(title: str, excerpts: list[tuple[int, str]]) -> tuple[str, int | None]:
    """The default generator's reply: the lead sentence of every excerpt, its most frequent long words as topics."""
    import json
    import re
    from collections import Counter

    claims, words, first = [], Counter(), {}
    for index, text in excerpts:
        lead = re.match(r"[^.!?]+[.!?]?", text)
        told = (lead.group() if lead else text).strip() or text.strip()
        if told:
            claims.append({"text": told, "source_indices": [index]})
        for word in re.findall(r"[a-z0-9]{6,}", text.lower()):
            words[word] += 1
            first.setdefault(word, index)
    best = sorted(words, key=lambda w: (-words[w], w))[:5]
    topics = [{"name": w, "aliases": [w[:5]], "source_indices": [first[w]]} for w in best]
    tokens = None if any("ouou" in text for _, text in excerpts) else sum(max(1, (len(text) + 3) // 4) for _, text in excerpts)
    return json.dumps({"summary_claims": claims, "topics": topics}, ensure_ascii=False), tokens
