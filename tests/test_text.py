from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import replies
from corpusloom.functions import text as T


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expression.alias("out")).first()["out"]


def test_whitespace_is_what_strip_removes():
    assert set(T.WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_fold_equals_casefold_for_ascii_tokens(spark):
    words = ["Straße", "ſofort", "ﬁn", "ŉ", "ẚ", "ABC", "K", "ﬆ", "ẞ"]
    rows = spark.createDataFrame([(w,) for w in words], ["w"]).select("w", T.token_set(F.col("w")).alias("t")).collect()
    import re

    for row in rows:
        assert set(row["t"]) == set(re.findall("[a-z0-9]+|[㐀-鿿]", row["w"].casefold()))


def test_normalisers(spark):
    text = "  ＭＦＡ---Control　策略 "
    assert one(spark, T.normalize_alias(F.col("x")), x=text) == "mfa control 策略"
    assert one(spark, T.merge_key(F.col("x")), x=text) == "mfacontrol策略"
    expected = " ".join(unicodedata.normalize("NFKC", text).casefold().split())
    assert one(spark, T.normalize_query(F.col("x")), x=text) == expected


def test_like_escape(spark):
    assert one(spark, T.escape_like(F.col("x")), x="vpn_%\\") == "vpn\\_\\%\\\\"


@pytest.mark.parametrize(
    ("left", "right", "value"), [("", "", 1.0), ("a b", "b c", 1 / 3), ("vpn", "vpn", 1.0), ("a", "", 0.0)]
)
def test_jaccard(spark, left, right, value):
    sets = T.jaccard(T.token_set(F.col("l")), T.token_set(F.col("r")))
    assert one(spark, sets, l=left, r=right) == pytest.approx(value)


def test_trigrams_are_padded(spark):
    assert set(one(spark, T.trigrams(F.col("x")), x="Cat")) == {"  c", " ca", "cat", "at "}


def test_names(spark):
    assert one(spark, T.safe_filename(F.col("x")), x="c:\\temp\\ report.md ") == "report.md"
    assert one(spark, T.safe_filename(F.col("x")), x="a/ ") == "upload"
    assert one(spark, T.title_of(F.col("x")), x="dir/ .md") == "Untitled"
    assert one(spark, T.file_suffix(F.col("x")), x="a/b.TAR.GZ") == ".gz"
    assert one(spark, T.file_suffix(F.col("x")), x=".txt") == ""


@pytest.mark.parametrize(
    ("text", "kept"),
    [
        ("a [1] b [9] c", "a [1] b  c"),
        ("[12] [0] [007] [x]", "  [007] [x]"),
        ("[[5] [1234] open [", "[[5] [1234] open ["),
        ("[3", "[3"),
    ],
)
def test_citation_filter(spark, text, kept):
    assert one(spark, T.keep_valid_citations(F.col("x"), F.lit(8)), x=text) == kept


def test_backoff(spark):
    assert one(spark, T.outbox_backoff(F.lit(20))) == 256
    assert one(spark, T.wiki_backoff(F.lit(9))) == 300
    assert one(spark, T.ingest_backoff(F.lit(9))) == 64


GOOD_TOPIC = '{"name": "VPN", "aliases": ["vpn", " "], "source_indices": [2]}'


@pytest.mark.parametrize(
    ("reply", "code"),
    [
        ('```json\n{"summary_claims": [{"text": " a ", "source_indices": [1, 1, 2]}], "topics": [%s]}\n```' % GOOD_TOPIC, None),
        ("not json", "invalid_json"),
        ("[]", "invalid_shape"),
        ('{"summary_claims": [], "topics": []}', "invalid_shape"),
        ('{"summary_claims": [{"text": "a", "source_indices": []}], "topics": []}', "invalid_source"),
        ('{"summary_claims": [{"text": "a", "source_indices": [99]}], "topics": []}', "invalid_source"),
        ('{"summary_claims": [{"text": "a", "source_indices": [0]}], "topics": []}', "invalid_source"),
        ('{"summary_claims": [{"text": "a", "source_indices": [true]}], "topics": []}', "invalid_source"),
        ('{"summary_claims": [{"text": "a", "source_indices": [1.0]}], "topics": []}', "invalid_source"),
        ('{"summary_claims": [{"text": 5, "source_indices": [1]}], "topics": []}', "invalid_shape"),
        ('{"summary_claims": [{"text": "a", "source_indices": [1]}, 7], "topics": []}', "invalid_shape"),
        ('{"summary_claims": [{"text": "a", "source_indices": [9]}, 7], "topics": []}', "invalid_source"),
        ('{"summary_claims": [{"text": "a", "source_indices": [1]}], "topics": [{"name": "n", "aliases": [1], "source_indices": [1]}]}', "invalid_shape"),
    ],
)
def test_reply_codes(spark, reply, code):
    assert one(spark, replies.reply_error(replies.parsed(F.col("x")), F.lit(3)), x=reply) == code


def test_reply_content(spark):
    reply = '{"summary_claims": [{"text": " a ", "source_indices": [2, 1, 2]}], "topics": [%s]}' % GOOD_TOPIC
    claims = one(spark, replies.reply_claims(replies.parsed(F.col("x"))), x=reply)
    assert [(c["text"], c["source_indices"]) for c in claims] == [("a", [2, 1])]
    topics = one(spark, replies.reply_topics(replies.parsed(F.col("x"))), x=reply)
    assert [(t["name"], t["aliases"], t["source_indices"]) for t in topics] == [("VPN", ["vpn"], [2])]
