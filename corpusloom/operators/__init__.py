"""Relational operators Spark does not ship: fusion, ranking, fuzzy and vector search."""
