"""URL filters: fixed rules first, then the ratio of two smoothed character models of variable order.

The URLs that rules allow and block are the samples of two character models. For each character the models take
the longest context up to `ORDER` characters and interpolate with shorter ones by Witten-Bell smoothing. A URL's
score is the mean difference of the log-likelihoods per character; the limit is calibrated on a fifth of the
ruled URLs, which the counts leave out: the point between the two classes' mean scores, nearer to the narrower.

All is DataFrame work: distinct URLs are cut into strings of up to ORDER + 1 characters, counted map-side, and
probabilities are built up by order on the distinct strings. Groups by context are as small as the alphabet.
The driver sees one row of calibration.

A null URL, or one without `://`, has empty host and path, no rule, and the score of the empty URL. Where one of
the two samples is empty, nothing can be compared and the verdict is allow. Repeated rows are judged alike.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tables import stored

ORDER = 3
ALPHABET = 256
# Rules as (verdict, host and path).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def ruled(urls: DataFrame) -> DataFrame:
    """Add host, path and the longest rule that fits, with its verdict."""
    urls = urls.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(RULES, key=lambda r: len(r[1])):
        host, path = text[: text.index("/")], text[text.index("/") :]
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return urls.select("*", rule.alias("rule"), verdict.alias("says"))


def grams(urls: DataFrame, *keep: str) -> DataFrame:
    """Strings of up to ORDER + 1 characters that end at each character of a URL and its end mark."""
    marked = F.concat(F.lit("\x02"), F.coalesce("url", F.lit("")), F.lit("\x03"))
    rows = urls.select(*keep, marked.alias("s"))
    ends = F.explode(F.sequence(F.lit(2), F.length("s"))).alias("i")
    return rows.select(*keep, "s", ends)


def models(urls: DataFrame) -> DataFrame:
    """gram, ratio: the log-likelihood ratio of the last character of every distinct string in its context."""
    ends = grams(urls, "yes", "no")
    cut = F.array(*[F.when(F.col("i") > k, F.expr(f"substring(s, i - {k}, {k + 1})")) for k in range(ORDER + 1)])
    cells = ends.select("yes", "no", F.posexplode(cut).alias("order", "gram")).where("gram is not null")
    counts = stored(cells.groupBy("order", "gram").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")))
    done, lower = None, None
    for order in range(ORDER + 1):
        own = counts.where(F.col("order") == order).select("gram", "yes", "no")
        context = F.expr(f"substring(gram, 1, {order})")
        totals = own.groupBy(context.alias("context")).agg(
            *[F.sum(c).alias(f"n_{c}") for c in ("yes", "no")],
            *[F.count(F.when(F.col(c) > 0, 1)).alias(f"t_{c}") for c in ("yes", "no")],
        )
        own = own.withColumn("context", context).join(totals, "context")
        if lower is None:
            own = own.select("*", F.lit(1 / ALPHABET).alias("l_yes"), F.lit(1 / ALPHABET).alias("l_no"))
        else:
            shorter = lower.select(F.col("gram").alias("rest"), F.col("p_yes").alias("l_yes"), F.col("p_no").alias("l_no"))
            own = own.withColumn("rest", F.substring("gram", 2, order)).join(shorter, "rest")
        p = [
            F.when(
                F.col(f"n_{c}") > 0,
                (F.col(c) + F.col(f"t_{c}") * F.col(f"l_{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}")),
            )
            .otherwise(F.col(f"l_{c}"))
            .alias(f"p_{c}")
            for c in ("yes", "no")
        ]
        lower = stored(own.select("gram", *p))
        done = lower if done is None else done.unionByName(lower)
    return done.select("gram", (F.log("p_yes") - F.log("p_no")).alias("ratio"))


def scores(urls: DataFrame, model: DataFrame) -> DataFrame:
    """url, score of every distinct URL; hot strings are joined by a skew-split join."""
    longest = F.expr(f"substring(s, greatest(1, i - {ORDER}), least(i, {ORDER + 1}))")
    cells = grams(urls, "url").select("url", longest.alias("gram"))
    return cells.join(stored(model), "gram").groupBy("url").agg(F.avg("ratio").alias("score"))


def judge(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every page."""
    urls = pages.select(F.coalesce("url", F.lit("")).alias("url")).distinct()
    known = stored(ruled(urls))
    held = F.crc32(F.col("url").cast("binary")) % 5 == 0
    counted = known.select(
        "url",
        (~held & (F.col("says") == "allow")).cast("long").alias("yes"),
        (~held & (F.col("says") == "block")).cast("long").alias("no"),
    ).na.fill(0)
    scored = stored(scores(known, models(counted)))
    fold = scored.join(known.where(held).where("says is not null").select("url", "says"), "url")
    stats = {r["says"]: r for r in fold.groupBy("says").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("d")).collect()}
    limit = 0.0
    if len(stats) == 2:
        yes, no = stats["allow"], stats["block"]
        spread = yes["d"] + no["d"]
        limit = (yes["m"] * no["d"] + no["m"] * yes["d"]) / spread if spread > 0 else (yes["m"] + no["m"]) / 2
    sums = counted.agg(F.sum("yes").alias("y"), F.sum("no").alias("n")).first()
    both = bool(sums["y"]) and bool(sums["n"])
    guess = F.when(F.col("score") >= limit, "allow").otherwise("block") if both else F.lit("allow")
    own = ruled(pages.select("page_id", "url")).withColumn("key", F.coalesce("url", F.lit("")))
    found = own.join(scored.withColumnRenamed("url", "key"), "key")
    return found.select("page_id", "host", "path", "rule", F.coalesce("says", guess).alias("verdict"), "score")
