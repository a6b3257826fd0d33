"""Registered queries and the SQL each of them is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.catalog import events, ingestion, retrieval, search, texts, wiki

MODULES = (retrieval, ingestion, wiki, search, texts, events)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for module in MODULES:
    QUERIES.update(module.QUERIES)
    SQL.update(module.SQL)
