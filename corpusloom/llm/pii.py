"""Personal data: base patterns, and further spans that generators propose and boosted trees select.

Four base kinds are found by pattern and arithmetic and always stay. High-recall generators propose overlapping
spans: digit groups, addresses written with words, keys after their names, and long mixed codes. Each proposal is
described by its form (digits, groups, letters, separators, length) and its context (the word before, the characters
around it). Gradient-boosted trees are fitted on all proposals, labelled by strict checks whose
outcomes are no features: a digit group is personal if it overlaps a base span, a code if a key's name
stands before it. The limit is the least score at which proposals of the held-out fold are right with
`PRECISION`. Selected proposals that overlap no base span and lie in no longer selected one are added.

Everything happens inside a document's row: matches, positions, checks, the trees (as nested conditions) and
the join of spans are column expressions, so nothing is shuffled but the counts of proposals. Positions count code
points, ends are exclusive. Documents without a digit or an at sign skip the patterns.

Proposals with the same features, label and fold are one row of the training table with their number as weight: all
count, and the table grows with the kinds of proposals rather than with the texts. Null and empty texts have no spans.
If the proposals have one class only, none is added. Repeated rows are treated alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tables import stored

# Base kinds in order, with their patterns; possessive where the pattern cannot match otherwise.
BASE = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?:[\x20-]?+[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
GENERATORS = (
    ("number", r"[+(]?[0-9](?:[\x20().\x2F:-]{0,2}+[0-9])++"),
    ("contact", r"[A-Za-z0-9._%+-]++(?:\x20?[\[(]at[\])]\x20?|\x20at\x20|@)[A-Za-z0-9-]++(?:(?:\.|\x20dot\x20)[A-Za-z0-9-]++)++"),
    ("key", r"(?i)\b(?:password|passwd|secret|token|api[_-]?key|access[_-]?key)\x20?[=:]\x20?[^\s]++"),
    ("code", r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_/+=-]{12,}+"),
)
TREES, DEPTH = 12, 3
BINS = 1024  # Spark looks at all rows for its split points up to BINS squared of them
PRECISION = 0.95
FEATURES = ("kind", "length", "digits", "groups", "letters", "marks", "plus", "paren", "lead", "tail", "colon_before", "word_before")


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, s), from the lengths of what lies between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.filter(F.arrays_zip(found.alias("s"), between.alias("gap")), lambda p: p["s"].isNotNull())
    empty = F.array().cast("array<struct<start:int,end:int,s:string>>")

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["s"])
        one = F.struct(start.alias("start"), end.alias("end"), pair["s"].alias("s"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    folded = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda state: state["out"])
    return F.when(F.size(found) > 0, folded).otherwise(empty)


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    total = F.aggregate(
        F.split(F.reverse(digits), ""),
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("sum")),
        lambda st, d: F.struct(
            (st["i"] + 1).alias("i"),
            (
                st["sum"]
                + F.when(st["i"] % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int"))
            ).alias("sum"),
        ),
        lambda st: st["sum"],
    )
    return total % 10 == 0


def valid(kind: str, s: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(s, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    digits = digits_of(s)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


def with_candidates(docs: DataFrame) -> DataFrame:
    """Add base (kind number, start, end) and proposals (the same, with features) to doc_id and text."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("t", F.when(F.col("text").rlike("[0-9@]") | F.col("text").rlike(r"\[at\]|\(at\)|\x20at\x20[A-Za-z0-9-]+(?:\.|\x20dot\x20)"), F.col("text")).otherwise(""))
    rows = rows.withColumns({f"m_{k}": matches(F.col("t"), p) for k, p in (*BASE, *GENERATORS)})

    def kept(number: int, kind: str) -> Column:
        good = F.filter(f"m_{kind}", lambda m: valid(kind, m["s"]))
        return F.transform(good, lambda m: F.struct(F.lit(number).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))

    def proposed(number: int, kind: str) -> Column:
        def describe(m: Column) -> Column:
            s = m["s"]
            before = F.substring(F.col("t"), F.greatest(F.lit(1), m["start"] - 11), F.least(F.lit(12), m["start"]))
            after = F.substring(F.col("t"), m["end"] + 1, F.lit(1))
            values = (
                F.lit(number),
                F.length(s),
                F.length(digits_of(s)),
                F.size(F.split(s, "[^0-9]+")),
                F.length(F.regexp_replace(s, "[^A-Za-z]", "")),
                F.length(F.regexp_replace(s, "[A-Za-z0-9]", "")),
                s.contains("+").cast("int"),
                s.contains("(").cast("int"),
                F.length(F.regexp_extract(s, "^[0-9]*", 0)),
                F.when(after.rlike("[0-9A-Za-z]"), 1).otherwise(0),
                before.rlike("[:=]\\x20?$").cast("int"),
                F.length(F.regexp_extract(before, "([A-Za-z]+)[^A-Za-z]*$", 1)),
            )
            named = [v.cast("double").alias(n) for v, n in zip(values, FEATURES, strict=True)]
            return F.struct(F.lit(number + len(BASE)).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.struct(*named).alias("f"))

        return F.transform(f"m_{kind}", describe)

    base = F.concat(*[kept(i, k) for i, (k, _) in enumerate(BASE)])
    proposals = F.concat(*[proposed(i, k) for i, (k, _) in enumerate(GENERATORS)])
    return rows.withColumns({"base": base, "proposals": proposals}).select("doc_id", "text", "base", "proposals")


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def counted(rows: DataFrame) -> DataFrame:
    """All labelled proposals by features, label and whether they belong to the held-out fold, with their number."""
    hit = F.exists("base", lambda b: overlaps(F.col("p"), b))
    strict = F.exists("proposals", lambda q: (q["kind"] == len(BASE) + 2) & overlaps(F.col("p"), q))
    flat = rows.where(F.size("proposals") > 0).select("doc_id", "base", "proposals", F.explode("proposals").alias("p"))
    label = F.when(F.col("p.kind") >= len(BASE) + 2, hit | strict).otherwise(hit)
    held = F.pmod(F.xxhash64("doc_id", "p.start"), F.lit(4)) == 0
    told = flat.select("p.f.*", label.cast("double").alias("label"), held.alias("held"))
    return stored(told.groupBy(*FEATURES, "label", "held").agg(F.count(F.lit(1)).cast("double").alias("weight")))


def tree_column(node, features: Column) -> Column:
    """One regression tree as nested conditions."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    test = features[FEATURES[split.featureIndex()]] <= float(split.threshold())
    return F.when(test, tree_column(node.leftChild(), features)).otherwise(tree_column(node.rightChild(), features))


def fitted(rows: DataFrame):
    """(score of a proposal, limit), or None where the proposals cannot teach."""
    known = counted(rows)
    classes = {r["label"] for r in known.select("label").distinct().collect()}
    if len(classes) < 2:
        return None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(known)
    learn = vectors.where("NOT held")
    if learn.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=11, maxBins=BINS, weightCol="weight").fit(learn)
    trees = [(w, tree._call_java("rootNode")) for w, tree in zip(model.treeWeights, model.trees, strict=True)]

    def score(features: Column) -> Column:
        margin = reduce(lambda a, b: a + b, [tree_column(root, features) * F.lit(float(w)) for w, root in trees])
        return 1 / (1 + F.exp(-2 * margin))

    held = model.transform(vectors.where("held")).select("label", "weight", F.round(vector_to_array("probability")[1], 2).alias("p"))
    rows = held.groupBy("p").agg(F.sum(F.col("label") * F.col("weight")).alias("right"), F.sum("weight").alias("all")).orderBy(F.desc("p")).collect()
    limit, right, total = 0.99, 0.0, 0
    for r in rows:
        right, total = right + r["right"], total + r["all"]
        if right >= PRECISION * total and r["p"] >= 0.5:
            limit = min(limit, r["p"] - 0.005)
    return score, limit


def all_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, base and spans: arrays of (start, kind, end), sorted; kinds count base, then generators."""
    rows = with_candidates(docs)
    model = fitted(rows)
    as_span = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    base = F.array_sort(F.transform("base", as_span))
    if model is None:
        return rows.select("doc_id", "text", base.alias("base"), base.alias("spans"))
    score, limit = model
    chosen = F.transform(F.filter("proposals", lambda p: (score(p["f"]) >= limit) & ~F.exists("base", lambda b: overlaps(p, b))), as_span)
    rows = rows.select("doc_id", "text", base.alias("base"), chosen.alias("chosen"))

    def inside(p: Column, q: Column) -> Column:
        longer = (q["end"] - q["start"] > p["end"] - p["start"]) | ((q["end"] - q["start"] == p["end"] - p["start"]) & (q["kind"] < p["kind"]))
        return overlaps(p, q) & longer

    added = F.filter("chosen", lambda p: ~F.exists("chosen", lambda q: inside(p, q)))
    return rows.select("doc_id", "text", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k, _ in (*BASE, *GENERATORS)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, the digest of the base spans, and all spans."""
    rows = all_spans(docs)

    def count(number: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, (k, _) in enumerate(BASE)]
    return rows.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """doc_id and the text with every span replaced by its kind in brackets; overlapping spans become one."""
    names = F.array(*[F.lit(k.upper()) for k, _ in (*BASE, *GENERATORS)])

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"])
        mark = F.concat(state["out"], gap, F.lit("["), names[s["kind"]], F.lit("]"))
        fresh = s["start"] >= state["at"]
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(fresh, mark).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.aggregate("spans", start, step, lambda st: F.concat(st["out"], F.substring(F.col("text"), st["at"] + 1, F.length("text"))))
    return all_spans(docs).select("doc_id", text.alias("text"))
