"""Trigram similarity search of queries against titled records."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import scan
from corpusloom.session import pinned

THRESHOLD = 0.1
EXACT = 4.0
SLUG = 2.0
GROUP_QUERIES = 128
GROUP_ROWS = 1024
PAIRS = 8192
FLOOR_RECORDS = 8192
FLOOR_ROWS = 512
MARGIN = 1e-6


def _columns_by(values: list[str]) -> dict[str, list[int]]:
    columns: dict[str, list[int]] = {}
    for column, value in enumerate(values):
        columns.setdefault(value, []).append(column)
    return columns


def gram_numbers(grams: Column) -> Column:
    """Trigrams as numbers made of their three code points."""

    def number(gram: Column) -> Column:
        first, second, third = (F.ascii(F.substring(gram, place, 1)).cast("long") for place in (1, 2, 3))
        return F.shiftleft(first, 42) + F.shiftleft(second, 21) + third

    return F.transform(grams, number)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at `starts`, one after the other."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))


class GramLists:
    """A batch of trigram sets: the own sizes, and the trigrams that any query has, numbered."""

    def __init__(self, lists: pa.Array, words: np.ndarray) -> None:
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
        self.sizes = np.asarray(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        places = np.minimum(np.searchsorted(words, values), max(len(words) - 1, 0))
        known = words[places] == values if len(words) else np.zeros(len(values), bool)
        self.codes = places[known]
        self.counts = np.bincount(np.repeat(np.arange(len(self.sizes)), self.sizes)[known], minlength=len(self.sizes))
        self.starts = np.cumsum(self.counts) - self.counts


class GramQueries:
    """The trigram sets of a block of queries, in groups of similar size."""

    def __init__(self, lists: list[list[int]]) -> None:
        self.sizes = np.array([len(grams) for grams in lists], dtype=np.int64)
        flat = np.array([gram for grams in lists for gram in grams], dtype=np.int64)
        self.words, codes = np.unique(flat, return_inverse=True)
        owners = np.repeat(np.arange(len(lists)), self.sizes)
        # One bit for each trigram and query: exact counts of single pairs look them up.
        self.bits = np.zeros((max(len(self.words), 1), -(-len(lists) // 8)), dtype=np.uint8)
        np.bitwise_or.at(self.bits, (codes, owners >> 3), (1 << (owners & 7)).astype(np.uint8))
        by_size = np.argsort(self.sizes, kind="stable")
        self.groups = [self._group(by_size[i : i + GROUP_QUERIES], codes, owners) for i in range(0, len(by_size), GROUP_QUERIES)]

    def _group(self, columns: np.ndarray, codes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(columns, places of a trigram's owners among them, trigram by trigram, where each begins, how many it has)."""
        place = np.full(len(self.sizes), -1, dtype=np.int32)
        place[columns] = np.arange(len(columns))
        mine = place[owners] >= 0
        order = np.argsort(codes[mine], kind="stable")
        fan = np.bincount(codes[mine], minlength=len(self.words))
        return columns, place[owners[mine][order]], np.cumsum(fan) - fan, fan

    def hopeful(self, lists: GramLists, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(list, query, similarity) of all pairs of a similarity of `least` or more, which is above 0, of each query.

        Sets of similarity s are at most 1 / s times as large as each other, so only lists of such sizes are counted.
        """
        by_size = np.argsort(lists.sizes, kind="stable")
        sizes = lists.sizes[by_size]
        for columns, owners, starts, fan in self.groups:
            own, need = self.sizes[columns].astype(np.float32), least[columns]
            low = need.min()
            if low > 1:
                continue
            first = np.searchsorted(sizes, own.min() * low - MARGIN, side="left")
            last = np.searchsorted(sizes, own.max() / low + MARGIN, side="right")
            factor, width = (1 + 1 / need).astype(np.float32), len(columns)
            for begin in range(max(first, np.searchsorted(sizes, 1)), last, GROUP_ROWS):
                part = by_size[begin : min(begin + GROUP_ROWS, last)]
                counts = lists.counts[part]
                some = np.flatnonzero(counts)
                part, counts = part[some], counts[some]
                if not len(part):
                    continue
                codes = lists.codes[_ranges(lists.starts[part], counts)]
                times = fan[codes]
                cells = np.repeat(np.repeat(np.arange(len(part), dtype=np.int32) * np.int32(width), counts), times)
                cells += owners[_ranges(starts[codes], times)]
                shared = np.bincount(cells, minlength=len(part) * width).reshape(len(part), width)
                # shared / (size + own - shared) >= need
                wanted = np.add.outer(lists.sizes[part].astype(np.float32), own - np.float32(0.01))
                found = np.flatnonzero(shared.astype(np.float32) * factor >= wanted)
                rows, cols = part[found // width], columns[found % width]
                shared = shared.ravel()[found]
                yield rows, cols, scan.rounded(shared / (lists.sizes[rows] + self.sizes[cols] - shared))

    def similarity(self, lists: GramLists, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Trigram similarity of pairs: shared over united, six digits."""
        shared = np.zeros(len(rows), dtype=np.int64)
        counts = lists.counts[rows]
        ends = np.cumsum(counts)
        for begin in range(0, len(rows), PAIRS):
            part = slice(begin, begin + PAIRS)
            codes = lists.codes[_ranges(lists.starts[rows[part]], counts[part])]
            owner = np.repeat(columns[part], counts[part])
            met = np.cumsum((self.bits[codes, owner >> 3] >> (owner & 7).astype(np.uint8)) & 1, dtype=np.int64)
            upto = np.concatenate([[0], met])[ends[part] - (ends[begin] - counts[begin])]
            shared[part] = np.diff(np.concatenate([[0], upto]))
        union = lists.sizes[rows] + self.sizes[columns] - shared
        return scan.rounded(np.divide(shared, union, out=np.zeros(len(rows)), where=union > 0))


def metadata_kernel(block: list[Row], k: int, details: bool = True) -> Callable[[pa.RecordBatch, np.ndarray], tuple]:
    """Scorer of (title, summary, slug, aliases) records; the score encodes the ranking keys.

    Exact matches add 4 and slug matches 2 to the relevance, which is at most 1, so one number
    orders by exact, slug, relevance. Pairs without either are looked at only where a trigram set is similar enough for
    the query's floor; of a batch, the `k` best of every query and their ties are told, with each field if `details`.
    """
    queries, width = GramQueries([row["grams"] for row in block]), len(block)
    by_name = _columns_by([row["query"] for row in block])
    by_slug = _columns_by([row["query"].replace(" ", "-") for row in block])
    lengths = sorted({len(slug) for slug in by_slug})
    scopes = [row["scope"] if "scope" in row else None for row in block]

    def name_matches(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """row x width + query of the exact and of the slug matches."""
        exact, prefix = [], []
        names = zip(*(batch.column(c).to_pylist() for c in ("low_title", "low_slug", "low_aliases")), strict=True)
        for row, (title, slug, aliases) in enumerate(names):
            for columns in (by_slug.get(slug), *(by_name.get(name) for name in (title, *(aliases or ())))):
                if columns:
                    exact += [row * width + column for column in columns]
            for length in lengths:
                if slug is None or length > len(slug):
                    break
                columns = by_slug.get(slug[:length])
                if columns:
                    prefix += [row * width + column for column in columns]
        return np.unique(np.array(exact, dtype=np.int64)), np.unique(np.array(prefix, dtype=np.int64))

    def similarities(lists: tuple[GramLists, ...], n_names: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of title, summary and best name of pairs."""
        rows, columns = pairs // width, pairs % width
        title, summary = (queries.similarity(own, rows, columns) for own in lists[:2])
        best, counts = np.zeros(len(rows)), n_names[rows]
        if counts.sum():
            each = queries.similarity(lists[2], _ranges((np.cumsum(n_names) - n_names)[rows], counts), np.repeat(columns, counts))
            some = np.flatnonzero(counts)
            best[some] = np.maximum.reduceat(each, (np.cumsum(counts) - counts)[some])
        return title, summary, best

    def kernel(batch: pa.RecordBatch, floors: np.ndarray) -> tuple:
        names = batch.column("alias_grams")
        n_names = np.asarray(pc.list_value_length(names).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        lists = tuple(GramLists(x, queries.words) for x in (batch.column("title_grams"), batch.column("summary_grams"), names.flatten()))
        exact, prefix = name_matches(batch)
        named = np.union1d(exact, prefix)
        # A pair without a name match counts only where its best field reaches the floor, and that field is found here.
        keys, values = [named], [np.zeros(len(named)) if not len(named) else np.max(similarities(lists, n_names, named), axis=0)]
        least = np.maximum(floors, THRESHOLD) - 2 * scan.MARGIN
        for own, row_of in zip(lists, (None, None, np.repeat(np.arange(len(n_names)), n_names)), strict=True):
            for rows, columns, similar in queries.hopeful(own, least):
                keys.append((rows if row_of is None else row_of[rows]) * width + columns)
                values.append(similar)
        keys, values = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(keys, kind="stable")
        pairs, firsts = np.unique(keys[order], return_index=True)
        relevance = np.maximum.reduceat(values[order], firsts) if len(pairs) else np.zeros(0)
        exact, prefix = np.isin(pairs, exact, assume_unique=True), np.isin(pairs, prefix, assume_unique=True)
        score = scan.rounded(relevance + EXACT * exact + SLUG * prefix)
        kept = ((relevance > THRESHOLD) | prefix) & (score >= floors[pairs % width])
        if any(scope is not None for scope in scopes):
            kept &= scan.allowed_matrix(scopes, scan.column_of(batch, "kb_id"))[pairs // width, pairs % width]
        kept = np.flatnonzero(kept)
        kept = kept[scan.best_of(pairs[kept] % width, score[kept], k)]
        pairs, score, exact, prefix = pairs[kept], score[kept], exact[kept], prefix[kept]
        fields = similarities(lists, n_names, pairs) if details else ()
        return pairs // width, pairs % width, score, *fields, prefix, exact

    return kernel


def with_floors(asked: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """`asked` with a `floor`: the k-th best score among some records, null where fewer match.

    The k best of all records score that or more, so all records are scanned with it from the start.
    """
    table = corpus.limit(FLOOR_RECORDS).toArrow().combine_chunks()
    records = [batch.slice(start, FLOOR_ROWS) for batch in table.to_batches() for start in range(0, batch.num_rows, FLOOR_ROWS)]

    def floors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), scan.MAX_BLOCK_QUERIES):
                block = frame.iloc[start : start + scan.MAX_BLOCK_QUERIES].copy()
                kernel = metadata_kernel(block.to_dict("records"), k, details=False)
                columns, scores, least = np.zeros(0, np.int64), np.zeros(0), np.full(len(block), -np.inf)
                for batch in records:
                    _, more, better, *_ = kernel(batch, least)
                    columns, scores = np.append(columns, more), np.append(scores, better)
                    order = np.lexsort((-scores, columns))
                    columns, scores = columns[order], scores[order]
                    place = np.arange(len(columns)) - np.searchsorted(columns, columns)
                    least[columns[place == k - 1]] = scores[place == k - 1]
                    columns, scores = columns[place < k], scores[place < k]
                block["floor"] = np.where(np.isfinite(least), least, None)
                yield block

    schema = ", ".join(f"{name} {kind}" for name, kind in asked.dtypes) + ", floor double"
    return asked.mapInPandas(floors, schema)


FIELDS = {
    "title_score": "double",
    "summary_score": "double",
    "alias_score": "double",
    "slug_matched": "boolean",
    "exact_match": "boolean",
}


def metadata_top_k(pages: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Best records per query by exact, slug, relevance, id, with their scores and matched fields.

    `pages` is (page_id string, kb_id, title, slug, summary, aliases array), `queries` is
    (query_id, query normalised[, scope]). Queries of the same text and scope have one answer and are scored once.
    Where more than one block of queries is asked, the records are written once with their trigrams, and every query gets
    a floor from some of them first; else they are dealt over the cores, for narrow records that come out of a join would be merged into a task or two.
    """
    text = [c for c in ("query", "scope") if c in queries.columns]
    members = pinned(queries.select("query_id", *text))
    asked = pinned(members.groupBy(*text).agg(F.min("query_id").alias("query_id"))).withColumn("grams", gram_numbers(T.trigrams(F.col("query"))))
    blocks = asked.limit(scan.MAX_BLOCK_QUERIES + 1).count() > scan.MAX_BLOCK_QUERIES
    dealt = pages if blocks else pages.repartition(pages.sparkSession.sparkContext.defaultParallelism, "page_id")
    corpus = dealt.select(
        F.col("page_id").alias("chunk_id"),
        "kb_id",
        F.lower("title").alias("low_title"),
        F.lower("slug").alias("low_slug"),
        F.transform("aliases", lambda a: F.lower(a)).alias("low_aliases"),
        gram_numbers(T.trigrams(F.col("title"))).alias("title_grams"),
        gram_numbers(T.trigrams(F.col("summary"))).alias("summary_grams"),
        F.transform("aliases", lambda a: gram_numbers(T.trigrams(a))).alias("alias_grams"),
    )
    if blocks:
        corpus = pinned(corpus)
        asked = pinned(with_floors(asked.repartition(asked.sparkSession.sparkContext.defaultParallelism, "query_id"), corpus, k))
    hits = scan.scan_top_k(corpus, asked, lambda block: metadata_kernel(block, k), k, extras=FIELDS, arrow=True, pairs=True)
    fields = F.array_compact(
        F.array(
            F.when(F.col("title_score") > THRESHOLD, "title"),
            F.when(F.col("summary_score") > THRESHOLD, "summary"),
            F.when(F.col("alias_score") > THRESHOLD, "alias"),
            F.when(F.col("slug_matched"), "slug"),
        )
    )
    named = asked.select(F.col("query_id").alias("asked_id"), *[F.col(c).alias(f"asked_{c}") for c in text])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"asked_{c}")) for c in text])
    twins = members.join(named, same).select(F.col("query_id").alias("member"), "asked_id")
    return hits.join(twins, hits["query_id"] == twins["asked_id"]).select(
        F.col("member").alias("query_id"),
        F.col("chunk_id").alias("page_id"),
        *FIELDS,
        F.greatest("title_score", "summary_score", "alias_score").alias("relevance"),
        fields.alias("matched_fields"),
    )
