"""Which texts contain which passages, by one anchored run of words for each passage.

A passage of three words or more holds words with a space on either side; where a text contains the passage, these
stand in the text as whole words in the same order. Of the runs of up to `RUN` such words the one that fewest texts
hold is the passage's anchor. Texts with the anchor are the candidates, and the whole passage is looked for in them.
A run held by many texts therefore costs nothing unless the passage has no rarer one, and then nearly all of its
candidates are results. Only hashes and ids are shuffled before candidates are known.

Passages of one or two words have no such run: blocks of them meet every text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import broadcast_if_small, pinned

RUN = 3
BLOCK_ROWS, BLOCK_BYTES = 2_000, 8 << 20


def _words(text: Column) -> Column:
    return F.split(text, " ")


def _runs(words: Column, length: int) -> Column:
    """Distinct hashes of all runs of `length` words, from word hashes laid beside each other."""
    one = F.transform(words, lambda w: F.xxhash64(F.lit(length), w))
    runs = one
    for ahead in range(1, length):
        following = F.slice(one, F.lit(ahead + 1), F.size(one))
        runs = F.zip_with(runs, following, lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.xxhash64(a, b)))
    return F.array_distinct(F.filter(runs, lambda run: run.isNotNull()))


def _anchored(passages: DataFrame, texts: DataFrame) -> list[DataFrame]:
    """(query_id, passage, doc_id, text) of all candidates."""
    inner = F.slice(_words(F.col("passage")), F.lit(2), F.size(_words(F.col("passage"))) - 2)
    length = F.least(F.lit(RUN), F.size("inner"))
    known = passages.withColumn("inner", inner).withColumn("length", length)
    used = sorted(row["length"] for row in known.select("length").distinct().collect())  # at most RUN numbers
    if not used:
        return []
    own = [known.where(F.col("length") == n).select("query_id", F.explode(_runs(F.col("inner"), n)).alias("run")) for n in used]
    runs = pinned(reduce(DataFrame.unionAll, own))
    present = F.concat(*[_runs(_words(F.col("text")), n) for n in used])
    asked = broadcast_if_small(runs.select("run").distinct())
    held = pinned(texts.select("doc_id", F.explode(present).alias("run")).join(asked, "run", "left_semi").distinct())
    counts = held.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("rarest")
    anchors = runs.join(counts, "run", "left").groupBy("query_id").agg(rarest).where("rarest.n > 0")
    pairs = pinned(anchors.select("query_id", F.col("rarest.run").alias("run")).join(held, "run").select("query_id", "doc_id"))
    wanted = broadcast_if_small(pairs.select("doc_id").distinct())
    return [pairs.join(passages, "query_id").join(texts.join(wanted, "doc_id", "left_semi"), "doc_id")]


def _met_by_all(passages: DataFrame, texts: DataFrame) -> list[DataFrame]:
    """(query_id, passage, doc_id, text) of every text with a block of passages."""
    size = passages.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("passage")).alias("b")).first()
    blocks = max(-(-size["n"] // BLOCK_ROWS), -(-(size["b"] or 0) // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("query_id", "passage"), F.lit(blocks))
    found = F.col("text").contains(F.col("passage"))
    return [texts.join(F.broadcast(passages.where(block == i)), found) for i in range(blocks)]


def containing(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, doc_id), each pair once: documents whose text contains the query's text.

    Empty and null texts on either side match nothing. One query_id or doc_id on several texts stands for all of them;
    rows without an id are left out. Other columns are not read.
    """
    passages = queries.where("query_id is not null and text <> ''").select("query_id", F.col("text").alias("passage"))
    texts = documents.where("doc_id is not null and text <> ''").select("doc_id", "text")
    # Runs are chosen for each passage, so one id on several texts has to be told apart until the end.
    named = F.struct("query_id", F.xxhash64("passage").alias("h"))
    passages = passages.distinct().select(named.alias("query_id"), "passage")
    short = F.size(_words(F.col("passage"))) < 3
    parts = _anchored(passages.where(~short), texts) + _met_by_all(passages.where(short), texts)
    if not parts:  # no passage at all
        parts = [passages.join(texts, F.col("passage") == F.col("text"))]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.where(F.col("text").contains(F.col("passage"))).select("query_id.query_id", "doc_id").distinct()
