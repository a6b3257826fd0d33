"""Registered text-function queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.catalog import sql as S
from corpusloom.functions import replies
from corpusloom.functions import text as T
from corpusloom.plans import retrieve
from corpusloom.sources import tables, wiki_tables


def token_sets(spark: SparkSession, folder: str) -> DataFrame:
    docs = tables.read(spark, folder, "documents", spread=True)
    tokens = docs.select("doc_id", T.token_set(F.col("text")).alias("tokens"))
    return tokens.select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        T.sha256_hex(F.array_join(F.array_sort("tokens"), " ")).alias("tokens_sha256"),
    )


def lexical_relevance(spark: SparkSession, folder: str) -> DataFrame:
    """Every document against the passage its number falls on; every passage of the table is used."""
    asked = tables.read(spark, folder, "benchmark").select("item_id", T.token_set(F.col("text")).alias("words"))
    docs = tables.read(spark, folder, "documents", spread=True).select(
        "doc_id", (F.col("doc_id") % asked.count()).alias("item_id"), T.token_set(F.col("text")).alias("tokens")
    )
    return docs.join(asked, "item_id").select(
        "doc_id", "item_id", F.round(T.overlap_share(F.col("words"), F.col("tokens")), 6).alias("relevance")
    )


def jaccard_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Similarity of every document to the next one of its source."""
    docs = tables.read(spark, folder, "documents", spread=True).select(
        "doc_id", T.token_set(F.col("text")).alias("tokens")
    )
    following = docs.select((F.col("doc_id") - 20).alias("doc_id"), F.col("tokens").alias("other"))
    return docs.join(following, "doc_id").select(
        "doc_id", F.round(T.jaccard(F.col("tokens"), F.col("other")), 6).alias("similarity")
    )


def text_normalisers(spark: SparkSession, folder: str) -> DataFrame:
    """All normal forms of every page name."""
    names = wiki_tables.alias_rows(spark, folder)
    alias = F.col("alias")
    return names.select(
        "page_id",
        F.col("position").cast("long").alias("position"),
        T.normalize_query(alias).alias("query_form"),
        T.normalize_alias(alias).alias("alias_form"),
        T.merge_key(alias).alias("merge_form"),
        T.slug_form(T.normalize_query(alias)).alias("slug_form"),
        T.escape_like(alias).alias("like_form"),
        T.excerpt(alias, 5).alias("head"),
        T.contains_ignoring_case(F.col("title"), alias).alias("in_title"),
    )


def trigram_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Trigram similarity of every page name to its page's title."""
    grams = wiki_tables.alias_rows(spark, folder).select(
        "page_id", "position", T.trigrams(F.col("alias")).alias("a"), T.trigrams(F.col("title")).alias("t")
    )
    return grams.select(
        "page_id",
        F.col("position").cast("long").alias("position"),
        F.size("a").cast("long").alias("n_trigrams"),
        F.round(T.trigram_similarity(F.col("a"), F.col("t")), 6).alias("similarity"),
    )


def retry_delays(spark: SparkSession, folder: str) -> DataFrame:
    """The three backoff rules over the attempt counts found in the events."""
    attempt = (F.get_json_object("props", "$.k").cast("int") % 12).alias("attempt")
    attempts = tables.read(spark, folder, "events").groupBy(attempt).agg(F.count(F.lit(1)).alias("n_events"))
    return attempts.select(
        F.col("attempt").cast("long").alias("attempt"),
        "n_events",
        T.outbox_backoff(F.col("attempt")).alias("outbox_seconds"),
        T.wiki_backoff(F.col("attempt")).alias("wiki_seconds"),
        T.ingest_backoff(F.col("attempt")).alias("ingest_seconds"),
    )


def marked_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages with a citation mark at their end."""
    number = (F.col("turn") % 12).cast("string")
    return tables.read(spark, folder, "conversations").select(
        "conv_id", "turn", F.concat("text", F.lit(" ["), number, F.lit("] [see 99] ["), (F.col("conv_id") % 1200).cast("string"), F.lit("]")).alias("text")
    )


def citation_filter(spark: SparkSession, folder: str) -> DataFrame:
    return marked_messages(spark, folder).select(
        "conv_id", "turn", T.keep_valid_citations(F.col("text"), F.lit(8)).alias("text")
    )


def scope_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Scope requests made from conversation turns: all bases, selections, malformed ones."""
    number = F.col("conv_id") * 7 + F.col("turn")
    first = F.concat(F.lit("src"), (number % 22).cast("string"))
    second = F.concat(F.lit("src"), (F.col("turn") % 20).cast("string"))
    none = F.array().cast("array<string>")
    return tables.read(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"),
        F.when(number % 11 == 0, "everything").when(number % 3 == 0, "all_enabled").otherwise("selected").alias("mode"),
        F.when(number % 3 == 0, F.when(number % 5 == 0, F.array(first)).otherwise(none))
        .when(number % 7 == 0, none)
        .otherwise(F.array(first, second, first))
        .alias("selected"),
    )


def scope_resolution(spark: SparkSession, folder: str) -> DataFrame:
    rows = retrieve.resolve_scopes(scope_requests(spark, folder), tables.knowledge_bases(spark, folder))
    return rows.select("request_id", "mode", "status", F.array_join("scope", ",").alias("scope"))


def scope_subset(spark: SparkSession, folder: str) -> DataFrame:
    """Tool calls of a turn against the turn's scope of two bases."""
    number = F.col("conv_id") * 7 + F.col("turn")
    scope = F.array(F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")), F.lit("src4"))
    asked = F.when(number % 4 == 0, F.array().cast("array<string>")).otherwise(
        F.array(F.lit("src4"), F.concat(F.lit("src"), (number % 20).cast("string")))
    )
    return tables.read(spark, folder, "conversations").select(
        "conv_id", "turn", retrieve.within_scope(asked, scope).alias("allowed")
    )


def model_replies(spark: SparkSession, folder: str) -> DataFrame:
    """Generated replies about every document, well formed or broken in one of several ways.

    A good reply has a claim for every line of the document that is not blank and up to six topics.
    """
    doc = F.col("doc_id")
    count = (doc % 5 + 1).cast("long")
    lines = F.filter(F.split("text", "\n"), lambda line: T.strip(line) != "")
    padded = lambda line: F.concat(F.lit(" "), T.first_sentence(line), F.lit(" "))
    sources = F.array(F.lit(1), count, F.lit(1))
    kind = doc % 9
    good = F.to_json(
        F.struct(
            F.transform(lines, lambda line: F.struct(padded(line).alias("text"), sources.alias("source_indices"))).alias("summary_claims"),
            F.transform(
                F.slice(F.sequence(F.lit(1), F.lit(6)), 1, (doc % 7).cast("int")),
                lambda i: F.struct(
                    F.concat_ws("-", "source", i).alias("name"),
                    F.array("lang", F.lit(" "), "lang").alias("aliases"),
                    F.array(count).alias("source_indices"),
                ),
            ).alias("topics"),
        )
    )
    claim = F.lit('{"text": "x", "source_indices": ')
    reply = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
        .when(kind == 1, F.concat(F.lit("\n "), good))
        .when(kind == 2, F.concat(F.lit("no reply for "), "source"))
        .when(kind == 3, F.lit("[1]"))
        .when(kind == 4, F.lit('{"summary_claims": [], "topics": []}'))
        .when(kind == 5, F.concat(F.lit('{"summary_claims": ['), claim, F.lit("["), (doc % 7).cast("string"), F.lit("]}], \"topics\": []}")))
        .when(kind == 6, F.concat(F.lit('{"summary_claims": ['), claim, F.lit('[1, true]}], "topics": []}')))
        .when(kind == 7, F.concat(F.lit('{"summary_claims": ['), claim, F.lit('[1]}], "topics": [{"name": "n", "aliases": [1], "source_indices": [1]}]}')))
        .otherwise(F.concat(F.lit('{"summary_claims": ['), claim, F.lit('[1]}, 5], "topics": []}')))
    )
    return tables.read(spark, folder, "documents", spread=True).select("doc_id", count.alias("count"), reply.alias("reply"))


def model_reply_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Every claim and topic of each valid reply; a faulty reply has one row with its code."""
    read = model_replies(spark, folder).withColumn("parsed", replies.parsed(F.col("reply")))
    coded = read.withColumn("code", replies.reply_error(F.col("parsed"), F.col("count")))
    numbers = lambda indices: F.array_join(F.transform(indices, lambda i: i.cast("string")), ",")

    def part(kind: str, no: Column, text: Column, aliases: Column, sources: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("part"), (no + 1).cast("long").alias("no"), text.alias("text"),
            aliases.alias("aliases"), numbers(sources).alias("sources"),
        )

    none = F.lit(None).cast("string")
    claims = F.transform(
        replies.reply_claims(F.col("parsed")), lambda c, no: part("claim", no, c["text"], none, c["source_indices"])
    )
    topics = F.transform(
        replies.reply_topics(F.col("parsed")),
        lambda t, no: part("topic", no, t["name"], F.array_join(t["aliases"], ","), t["source_indices"]),
    )
    faulty = F.struct(
        F.lit("code").alias("part"), F.lit(0).cast("long").alias("no"), F.col("code").alias("text"),
        none.alias("aliases"), none.alias("sources"),
    )
    parts = F.when(F.col("code").isNull(), F.concat(claims, topics)).otherwise(F.array(faulty))
    return coded.select("doc_id", F.inline(parts))


QUERIES = {
    "token_sets": token_sets,
    "lexical_relevance": lexical_relevance,
    "jaccard_pairs": jaccard_pairs,
    "text_normalisers": text_normalisers,
    "trigram_pairs": trigram_pairs,
    "outbox_backoff": retry_delays,
    "citation_filter": citation_filter,
    "scope_resolution": scope_resolution,
    "scope_subset": scope_subset,
    "model_reply_validation": model_reply_validation,
}

from corpusloom.catalog.search import GRAMS, NORMAL, SIMILARITY  # noqa: E402
from corpusloom.catalog.wiki import ALIAS, FIRST_SENTENCE, KEY, PAGES  # noqa: E402

TOKEN_SET = "list_distinct(" + S.TERMS + ")"

MESSAGES = """
messages AS (
  SELECT conv_id, turn, text || ' [' || turn % 12 || '] [see 99] [' || conv_id % 1200 || ']' AS text FROM conversations)"""

FILTERED = """
filtered AS (
  SELECT conv_id, turn, array_to_string(list_filter(regexp_extract_all(text, '\\[[^\\]]*\\]|[^\\[]+|\\['),
    lambda p: NOT regexp_full_match(p, '\\[[0-9]{1,3}\\]')
              OR CAST(substr(p, 2, length(p) - 2) AS INTEGER) BETWEEN 1 AND 8), '') AS text
  FROM (SELECT * FROM messages))""".replace(
    "CAST(substr(p, 2, length(p) - 2) AS INTEGER)", "TRY_CAST(substr(p, 2, length(p) - 2) AS INTEGER)"
)

SQL = {
    "token_sets": f"""
SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, sha256(array_to_string(list_sort(tokens), ' ')) AS tokens_sha256
FROM (SELECT doc_id, {TOKEN_SET.format('text')} AS tokens FROM documents)""",
    "lexical_relevance": f"""
SELECT doc_id, item_id, round(len(list_intersect(words, tokens)) / len(words), 6) AS relevance
FROM (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS item_id, {TOKEN_SET.format('text')} AS tokens FROM documents)
     JOIN (SELECT item_id, {TOKEN_SET.format('text')} AS words FROM benchmark) USING (item_id)""",
    "jaccard_pairs": f"""
WITH t AS (SELECT doc_id, {TOKEN_SET.format('text')} AS tokens FROM documents)
SELECT a.doc_id, round(CASE WHEN len(a.tokens) + len(b.tokens) = 0 THEN 1.0 ELSE len(list_intersect(a.tokens, b.tokens))
  / (len(a.tokens) + len(b.tokens) - len(list_intersect(a.tokens, b.tokens))) END, 6) AS similarity
FROM t a JOIN t b ON b.doc_id = a.doc_id + 20""",
    "text_normalisers": S.sql(
        S.BASES, S.DIM, PAGES,
        select=f"""
SELECT page_id, position, {NORMAL.format('alias')} AS query_form, {ALIAS.format('alias')} AS alias_form,
       {KEY.format('alias')} AS merge_form, replace({NORMAL.format('alias')}, ' ', '-') AS slug_form,
       replace(replace(replace(alias, '\\', '\\\\'), '%', '\\%'), '_', '\\_') AS like_form, substr(alias, 1, 5) AS head,
       contains(lower(title), lower(alias)) AS in_title
FROM alias_rows""",
    ),
    "trigram_pairs": S.sql(
        S.BASES, S.DIM, PAGES,
        select=f"""
SELECT page_id, position, CAST(len(a) AS BIGINT) AS n_trigrams, round({SIMILARITY.format('a', 't')}, 6) AS similarity
FROM (SELECT page_id, position, {GRAMS.format('alias')} AS a, {GRAMS.format('title')} AS t FROM alias_rows)""",
    ),
    "outbox_backoff": """
SELECT attempt, n_events, CAST(least(300, pow(2, least(attempt, 8))) AS BIGINT) AS outbox_seconds,
       CAST(least(300, pow(2, attempt)) AS BIGINT) AS wiki_seconds, CAST(pow(2, least(attempt, 6)) AS BIGINT) AS ingest_seconds
FROM (SELECT CAST(json_extract(props, '$.k') AS BIGINT) % 12 AS attempt, count(*) AS n_events FROM events GROUP BY 1)""",
    "citation_filter": S.sql(MESSAGES, FILTERED, select="SELECT conv_id, turn, text FROM filtered"),
    "scope_resolution": S.sql(
        S.BASES,
        """requests AS (
  SELECT conv_id * 1000 + turn AS request_id,
         CASE WHEN n % 11 = 0 THEN 'everything' WHEN n % 3 = 0 THEN 'all_enabled' ELSE 'selected' END AS mode,
         CASE WHEN n % 3 = 0 THEN CASE WHEN n % 5 = 0 THEN ['src' || n % 22] ELSE [] END WHEN n % 7 = 0 THEN []
              ELSE ['src' || n % 22, 'src' || turn % 20] END AS selected
  FROM (SELECT *, conv_id * 7 + turn AS n FROM conversations)),
judged AS (
  SELECT *, CASE WHEN mode = 'everything' THEN 'invalid_knowledge_scope'
              WHEN mode = 'selected' AND len(selected) = 0 THEN 'empty_knowledge_scope'
              WHEN mode = 'all_enabled' AND len(selected) > 0 THEN 'invalid_knowledge_scope'
              WHEN NOT list_has_all((SELECT list(kb_id) FROM knowledge_bases WHERE enabled), selected)
                THEN 'knowledge_scope_unavailable' ELSE 'ok' END AS status FROM requests)""",
        select="""
SELECT request_id, mode, status, CASE WHEN status = 'ok' AND len(selected) > 0
         THEN array_to_string(list_sort(list_distinct(selected)), ',') END AS scope
FROM judged""",
    ),
    "scope_subset": """
SELECT conv_id, turn, (conv_id * 7 + turn) % 4 = 0 OR (conv_id * 7 + turn) % 20 IN (conv_id % 20, 4) AS allowed FROM conversations""",
    "model_reply_validation": f"""
WITH replies AS (
  SELECT doc_id, doc_id % 9 AS kind, doc_id % 5 + 1 AS n, source, lang,
         list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '') AS lines FROM documents),
coded AS (
  SELECT *, CASE kind WHEN 2 THEN 'invalid_json' WHEN 3 THEN 'invalid_shape' WHEN 4 THEN 'invalid_shape'
              WHEN 5 THEN CASE WHEN doc_id % 7 NOT BETWEEN 1 AND n THEN 'invalid_source' END
              WHEN 6 THEN 'invalid_source' WHEN 7 THEN 'invalid_shape' WHEN 8 THEN 'invalid_shape'
              ELSE CASE WHEN len(lines) = 0 THEN 'invalid_shape' END END AS code FROM replies)
SELECT doc_id, 'code' AS part, 0::BIGINT AS no, code AS text, NULL::VARCHAR AS aliases, NULL::VARCHAR AS sources
FROM coded WHERE code IS NOT NULL
UNION ALL
SELECT doc_id, 'claim', no, substr(trim({FIRST_SENTENCE.format('line')}), 1, 2000), NULL, CASE WHEN n = 1 THEN '1' ELSE '1,' || n END
FROM (SELECT *, unnest(lines) AS line, generate_subscripts(lines, 1) AS no FROM coded WHERE code IS NULL AND kind < 2)
UNION ALL
SELECT doc_id, 'claim', 1, 'x', NULL, CAST(doc_id % 7 AS VARCHAR) FROM coded WHERE code IS NULL AND kind = 5
UNION ALL
SELECT doc_id, 'topic', no, source || '-' || no, lang, CAST(n AS VARCHAR)
FROM (SELECT *, unnest(range(1, least(5, doc_id % 7) + 1)) AS no FROM coded WHERE code IS NULL AND kind < 2)""",
}
