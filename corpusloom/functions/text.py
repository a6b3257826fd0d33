"""Text functions: normalisers, tokenisers, similarities, identifiers, rendering helpers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The characters str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Characters whose case folding differs from lower-casing and yields ASCII letters.
FOLDS_TO_ASCII = {
    "ß": "ss", "ſ": "s", "ŉ": "ʼn", "ǰ": "ǰ", "ẖ": "ẖ", "ẗ": "ẗ", "ẘ": "ẘ", "ẙ": "ẙ", "ẚ": "aʾ",
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st",
}
TOKEN = "[a-z0-9]+|[㐀-鿿]"
NON_WORD = r"[^\p{L}\p{N}_]+"


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace, the Unicode kinds included."""
    return F.btrim(text, F.lit(WHITESPACE))


def sha256_hex(text: Column) -> Column:
    """Content fingerprint: hex digest of the UTF-8 bytes."""
    return F.sha2(text, 256)


def short_digest(text: Column) -> Column:
    """First sixteen hex digits of the fingerprint, used for query ids and topic slugs."""
    return F.substring(F.sha2(text, 256), 1, 16)


def fold(text: Column) -> Column:
    """Case folding without compatibility normalisation, in the JVM; the replacements only where a text is not ASCII."""
    folded = F.lower(text)
    for char, ascii_form in FOLDS_TO_ASCII.items():
        folded = F.replace(folded, F.lit(char), F.lit(ascii_form))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(folded)


@F.pandas_udf(StringType())
def _compatibility_fold(values: pd.Series) -> pd.Series:
    return values.map(
        lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold()
    )


def compatibility_fold(text: Column) -> Column:
    """NFKC and case folding; only rows with non-ASCII characters carry text to Python."""
    foreign = F.when(text.rlike(r"[^\x00-\x7f]"), text)
    return F.coalesce(_compatibility_fold(foreign), F.lower(text))


def normalize_query(text: Column) -> Column:
    """Query form: folded, trimmed, whitespace runs collapsed to one space."""
    return F.regexp_replace(strip(compatibility_fold(text)), "[" + WHITESPACE + "]+", " ")


def normalize_alias(text: Column) -> Column:
    """Alias form: folded, runs of non-word characters become one space."""
    return strip(F.regexp_replace(strip(compatibility_fold(text)), NON_WORD, " "))


def merge_key(text: Column) -> Column:
    """Merge form: folded, non-word characters removed."""
    return F.regexp_replace(strip(compatibility_fold(text)), NON_WORD, "")


def terms(folded: Column) -> Column:
    """All tokens of an already folded text, repeats kept."""
    return F.regexp_extract_all(folded, F.lit(TOKEN), F.lit(0))


def token_set(text: Column) -> Column:
    """Distinct ASCII words and single CJK characters of the case-folded text."""
    return F.array_distinct(terms(fold(text)))


def query_token_set(text: Column) -> Column:
    """Distinct tokens of the compatibility-folded text."""
    return F.array_distinct(terms(normalize_query(text)))


def overlap_share(query_tokens: Column, text_tokens: Column) -> Column:
    """Share of the query tokens found in the text; 0 for a query without tokens."""
    hits = F.size(F.array_intersect(query_tokens, text_tokens))
    return F.when(F.size(query_tokens) == 0, F.lit(0.0)).otherwise(
        hits / F.greatest(F.size(query_tokens), F.lit(1))
    )


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard similarity of two token arrays; two empty sets are equal."""
    union = F.size(F.array_union(left, right))
    shared = F.size(F.array_intersect(left, right))
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / F.greatest(union, F.lit(1)))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-cased words, each padded two left and one right."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))

    def of_word(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(
            F.sequence(F.lit(1), F.length(padded) - 2),
            lambda start: F.substring(padded, start, F.lit(3)),
        )

    return F.array_distinct(F.flatten(F.transform(words, of_word)))


def trigram_similarity(left: Column, right: Column) -> Column:
    """Shared over united trigrams of two trigram arrays; 0 when both are empty."""
    union = F.size(F.array_union(left, right))
    shared = F.size(F.array_intersect(left, right))
    return F.when(union == 0, F.lit(0.0)).otherwise(shared / F.greatest(union, F.lit(1)))


def contains_ignoring_case(text: Column, needle: Column) -> Column:
    """Case-insensitive substring test; `%`, `_` and `\\` in the needle are literal."""
    return F.contains(F.lower(text), F.lower(needle))


def escape_like(text: Column) -> Column:
    """The needle as a LIKE literal, for engines that take a pattern."""
    escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(escaped, F.lit("%"), F.lit("\\%")), F.lit("_"), F.lit("\\_"))


def slug_form(query: Column) -> Column:
    """A normalised query as it would start a slug."""
    return F.replace(query, F.lit(" "), F.lit("-"))


def slug_prefix_match(slug: Column, query: Column) -> Column:
    """Whether the slug starts with the query, spaces read as hyphens."""
    return F.startswith(F.lower(slug), slug_form(query))


def safe_filename(name: Column) -> Column:
    """Last path segment of a client-supplied name, `upload` when nothing is left."""
    segments = F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/")
    return F.coalesce(F.nullif(strip(F.element_at(segments, -1)), F.lit("")), F.lit("upload"))


def file_suffix(name: Column) -> Column:
    """Lower-cased extension of the last path segment, empty when there is none."""
    base = F.element_at(F.split(name, "/"), -1)
    return F.lower(F.regexp_extract(base, r"(?s)^.+(\.[^.]+)$", 1))


def title_of(name: Column) -> Column:
    """File stem as title, `Untitled` when it is blank."""
    base = F.element_at(F.split(name, "/"), -1)
    stem = F.regexp_replace(base, r"(?s)^(.+)\.[^.]+$", "$1")
    return F.coalesce(F.nullif(strip(stem), F.lit("")), F.lit("Untitled"))


def embedding_fingerprint(provider: Column, model: Column, dimension: Column) -> Column:
    """Fingerprint of the embedding configuration a version was built with."""
    parts = (provider, F.coalesce(model, F.lit("")), dimension.cast("string"))
    return F.sha2(F.concat_ws("|", *parts), 256)


def token_estimate(text: Column) -> Column:
    """Rough token count: a quarter of the characters, rounded up, at least one."""
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4).cast("int"))


def embedding_text(heading_path: Column, content: Column) -> Column:
    """What is embedded for a child: its heading trail on a first line, then the text."""
    trail = F.array_join(heading_path, " > ")
    return F.when(trail != "", F.concat(trail, F.lit("\n"), content)).otherwise(content)


def excerpt(text: Column, characters: int) -> Column:
    """The first `characters` code points."""
    return F.substring(text, 1, characters)


def backoff_seconds(attempt: Column, exponent_cap: int | None, ceiling: int | None) -> Column:
    """Exponential delay with an optional cap on the exponent and on the delay."""
    exponent = attempt if exponent_cap is None else F.least(attempt, F.lit(exponent_cap))
    if exponent_cap is None:
        exponent = F.least(exponent, F.lit(62))
    delay = F.pow(F.lit(2.0), exponent)
    return (delay if ceiling is None else F.least(F.lit(float(ceiling)), delay)).cast("long")


def outbox_backoff(attempt: Column) -> Column:
    return backoff_seconds(attempt, 8, 300)


def wiki_backoff(attempt: Column) -> Column:
    return backoff_seconds(attempt, None, 300)


def ingest_backoff(attempt: Column) -> Column:
    return backoff_seconds(attempt, 6, None)


def keep_valid_citations(text: Column, available: Column) -> Column:
    """Drop `[n]` marks (one to three digits) outside 1..available, keep all other text."""
    pieces = F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]|[^\[]+|\["), F.lit(0))

    def keep(piece: Column) -> Column:
        number = F.substring(piece, F.lit(2), F.length(piece) - 2).try_cast("int")
        return ~piece.rlike(r"^\[[0-9]{1,3}\]$") | number.between(F.lit(1), available)

    return F.array_join(F.filter(pieces, keep), "")


def page_passage(title: Column, aliases: Column, summary: Column, first_claim: Column) -> Column:
    """What a page reranker reads: title, aliases, summary and first claim on four lines."""
    empty = F.lit("")
    parts = (title, F.array_join(aliases, " "), summary, first_claim)
    return F.concat_ws("\n", *(F.coalesce(part, empty) for part in parts))


def first_sentence(text: Column) -> Column:
    """Text up to the first full stop, question or exclamation mark."""
    head = F.regexp_extract(text, r"^[^.!?]+[.!?]?", 0)
    return F.coalesce(F.nullif(strip(head), F.lit("")), text)


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ts)
