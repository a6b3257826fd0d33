"""Validation of generated JSON replies with stable error codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import strip

TEXT_CHARACTERS = 2000
NAME_CHARACTERS = 80
TOPICS_READ = 5


def unfenced(reply: Column) -> Column:
    """The reply without a surrounding code fence."""
    body = strip(reply)
    inner = F.regexp_replace(body, r"(?s)^```[^\n]*\n", "")
    inner = F.regexp_replace(inner, r"(?s)^(.*)```.*$", "$1")
    return F.when(F.startswith(body, F.lit("```")), strip(inner)).otherwise(body)


def parsed(reply: Column) -> Column:
    """The reply as a variant, null when it is not JSON."""
    return F.try_parse_json(unfenced(reply))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _items(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "array<variant>")


def _is_text(item: Column, path: str) -> Column:
    value = F.try_variant_get(item, path, "variant")
    text = F.try_variant_get(item, path, "string")
    return F.coalesce((_kind(value) == "STRING") & (strip(text) != ""), F.lit(False))


def _is_object(item: Column) -> Column:
    return F.coalesce(F.startswith(_kind(item), F.lit("OBJECT")), F.lit(False))


def _bad_sources(item: Column, count: Column) -> Column:
    """Whether the source indices are no list of whole numbers in 1..count; booleans are none."""
    indices = _items(item, "$.source_indices")
    bad = F.exists(
        indices,
        lambda i: F.coalesce(
            (_kind(i) != "BIGINT") | ~F.try_variant_get(i, "$", "long").between(F.lit(1), count), F.lit(True)
        ),
    )
    return F.coalesce((F.size(indices) == 0) | bad, F.lit(True))


def _claim_error(item: Column, count: Column) -> Column:
    return F.when(~_is_text(item, "$.text"), "invalid_shape").when(_bad_sources(item, count), "invalid_source")


def _topic_error(item: Column, count: Column) -> Column:
    aliases = _items(item, "$.aliases")
    odd = F.exists(aliases, lambda a: F.coalesce(_kind(a) != "STRING", F.lit(True)))
    shape = ~_is_text(item, "$.name") | aliases.isNull() | F.coalesce(odd, F.lit(False))
    return F.when(shape, "invalid_shape").when(_bad_sources(item, count), "invalid_source")


def reply_error(reply: Column, count: Column) -> Column:
    """Error code of a parsed reply, null when it is valid.

    `reply` is the variant of `parsed`, `count` the number of source chunks. The first faulty
    object names the code, claims before topics; entries that are no objects come after that.
    """
    claims, topics = _items(reply, "$.summary_claims"), F.slice(_items(reply, "$.topics"), 1, TOPICS_READ)
    shapeless = ~_is_object(reply) | claims.isNull() | topics.isNull() | (F.size(claims) == 0)
    errors = F.concat(
        F.transform(F.filter(claims, _is_object), lambda c: _claim_error(c, count)),
        F.transform(F.filter(topics, _is_object), lambda t: _topic_error(t, count)),
    )
    odd = F.exists(F.concat(claims, topics), lambda x: ~_is_object(x))
    return (
        F.when(reply.isNull(), "invalid_json")
        .when(F.coalesce(shapeless, F.lit(True)), "invalid_shape")
        .otherwise(F.coalesce(F.get(F.array_compact(errors), 0), F.when(odd, "invalid_shape")))
    )


def reply_claims(reply: Column) -> Column:
    """Array of (text, source_indices) of a valid reply, indices unique in order."""
    return F.transform(
        _items(reply, "$.summary_claims"),
        lambda c: F.struct(
            F.substring(strip(F.try_variant_get(c, "$.text", "string")), 1, TEXT_CHARACTERS).alias("text"),
            F.array_distinct(F.try_variant_get(c, "$.source_indices", "array<long>")).alias("source_indices"),
        ),
    )


def reply_topics(reply: Column) -> Column:
    """Array of (name, aliases, source_indices) of a valid reply, at most five."""
    return F.transform(
        F.slice(_items(reply, "$.topics"), 1, TOPICS_READ),
        lambda t: F.struct(
            F.substring(strip(F.try_variant_get(t, "$.name", "string")), 1, NAME_CHARACTERS).alias("name"),
            F.array_distinct(
                F.transform(
                    F.filter(F.try_variant_get(t, "$.aliases", "array<string>"), lambda a: strip(a) != ""),
                    lambda a: F.substring(strip(a), 1, NAME_CHARACTERS),
                )
            ).alias("aliases"),
            F.array_distinct(F.try_variant_get(t, "$.source_indices", "array<long>")).alias("source_indices"),
        ),
    )
