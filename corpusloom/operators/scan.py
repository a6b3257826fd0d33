"""Scoring a corpus against a block of queries with the top-k taken where the rows are.

Per-query top-k over a whole corpus would otherwise shuffle every (query, row) score. Here each
partition keeps only its own k best rows per query, so the shuffle holds `partitions x queries x k`
rows. Queries travel to the tasks in blocks of bounded size; more queries mean more passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from corpusloom.operators.ordering import top_k

MAX_BLOCK_QUERIES = 2048
MAX_CELLS = 1_000_000
PAIR_ROWS = 4096
SCORE_DIGITS = 6
MARGIN = 10.0**-SCORE_DIGITS


def query_blocks(queries: DataFrame, key: str, max_rows: int) -> Iterator[list[Row]]:
    """The queries in blocks of about `max_rows`, one block on the driver at a time."""
    head = queries.limit(max_rows + 1).collect()
    if len(head) <= max_rows:
        yield head
        return
    blocks = -(-queries.count() // max_rows)
    for block in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == block).collect()
        if rows:
            yield rows


def rounded(scores: np.ndarray) -> np.ndarray:
    """Scores at six digits, halves away from zero as in SQL."""
    shift = 10.0**SCORE_DIGITS
    return np.sign(scores) * np.floor(np.abs(scores) * shift + 0.5) / shift


def allowed_matrix(scopes: list[list | None], bases: np.ndarray) -> np.ndarray:
    """Rows x queries: whether the row's base is in the query's scope; no scope admits all."""
    allowed = np.ones((len(bases), len(scopes)), dtype=bool)
    scoped = [column for column, scope in enumerate(scopes) if scope is not None]
    if scoped:
        codes, different = pd.factorize(bases, use_na_sentinel=False)
        members = [set(scopes[column]) for column in scoped]
        of_base = np.array([[base in member for member in members] for base in different], dtype=bool)
        allowed[:, scoped] = of_base.reshape(len(different), len(scoped))[codes]
    return allowed


class OwnerIndex:
    """Which queries of a block own each term; matches batches of term lists against all of them."""

    def __init__(self, term_lists: list[list[str]], known: set[str] | None = None) -> None:
        owners: dict[str, list[int]] = {}
        for column, words in enumerate(term_lists):
            for word in words:
                if known is None or word in known:
                    owners.setdefault(word, []).append(column)
        self.width = len(term_lists)
        self.words = list(owners)
        self.number = {word: no for no, word in enumerate(self.words)}
        self.fan = np.array([len(owners[word]) for word in self.words], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.fan)])[:-1].astype(np.int64)
        self.columns = np.array([c for word in self.words for c in owners[word]], dtype=np.int64)

    def matches(self, term_lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, count) of the owned terms in each list."""
        sizes = np.fromiter((len(words) for words in term_lists), np.int64, len(term_lists))
        get = self.number.get
        codes = np.fromiter(
            (get(word, -1) for words in term_lists for word in words), np.int64, int(sizes.sum())
        )
        rows = np.repeat(np.arange(len(term_lists)), sizes)
        owned = codes >= 0
        span = max(len(self.words), 1)
        pairs, count = np.unique(rows[owned] * span + codes[owned], return_counts=True)
        return pairs // span, pairs % span, count

    def spread(self, rows: np.ndarray, terms: np.ndarray, values: np.ndarray, height: int) -> np.ndarray:
        """Add each (row, term) value to the cells of all queries owning the term."""
        fan = self.fan[terms]
        within = np.arange(int(fan.sum())) - np.repeat(np.cumsum(fan) - fan, fan)
        columns = self.columns[np.repeat(self.starts[terms], fan) + within]
        cells = np.repeat(rows, fan) * self.width + columns
        flat = np.bincount(cells, np.repeat(values, fan), height * self.width)
        return flat.astype(np.float64, copy=False).reshape(height, self.width)


def best_rows(scores: np.ndarray, eligible: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) positions of the k best eligible scores per query, ties at the cut kept."""
    rows, columns = [], []
    for column in range(scores.shape[1]):
        picked = np.flatnonzero(eligible[:, column])
        if len(picked) > k:
            values = scores[picked, column]
            cut = np.partition(values, len(values) - k)[len(values) - k]
            picked = picked[values >= cut]
        rows.append(picked)
        columns.append(np.full(len(picked), column))
    return np.concatenate(rows), np.concatenate(columns)


def best_of(columns: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores of each query in flat arrays, ties at the cut kept."""
    counts = np.bincount(columns)
    if not len(counts) or counts.max() <= k:
        return np.arange(len(columns))
    order = np.lexsort((-scores, columns))
    starts = np.cumsum(counts) - counts
    owner = columns[order]
    cut = np.full(len(counts), -np.inf)
    many = np.flatnonzero(counts > k)
    cut[many] = scores[order][starts[many] + k - 1]
    return np.sort(order[scores[order] >= cut[owner]])


def rows_to_hold(
    scores: np.ndarray, eligible: np.ndarray, floors: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, query) positions that reach their query's floor, and their rounded scores.

    Few do once floors are high: they are found in one pass over all queries and only they are rounded. Where many do,
    each query is cut to its k best rows.
    """
    hopeful = eligible & (scores >= floors - MARGIN)
    if np.count_nonzero(hopeful) > 2 * k * scores.shape[1]:
        scores = rounded(scores)
        rows, columns = best_rows(scores, eligible & (scores >= floors), k)
        return rows, columns, scores[rows, columns]
    rows, columns = np.nonzero(hopeful)
    values = rounded(scores[rows, columns])
    kept = values >= floors[columns]
    return rows[kept], columns[kept], values[kept]


def keep_best(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows per query by score, then by id."""
    ordered = frame.sort_values(["query_id", "score", "chunk_id"], ascending=[True, False, True])
    return ordered.groupby("query_id", sort=False).head(k)


def full_floors(best: pd.DataFrame, ids: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of every query that has k rows: what scores less cannot be among its best."""
    scores = best.groupby("query_id")["score"].agg(["size", "min"])
    lowest = scores["min"].where(scores["size"] >= k, -np.inf)
    return lowest.reindex(ids).fillna(-np.inf).to_numpy()


Batch = pd.DataFrame | pa.RecordBatch


def column_of(batch: Batch, name: str) -> np.ndarray:
    if isinstance(batch, pa.RecordBatch):
        return batch.column(name).to_numpy(zero_copy_only=False)
    return batch[name].to_numpy()


def slices(batches: Iterator[Batch], width: int, rows: int | None = None) -> Iterator[Batch]:
    """Batches cut to `rows`, by default so that rows x queries stays below MAX_CELLS, which bounds a task's memory."""
    rows = rows or max(1, MAX_CELLS // max(width, 1))
    for batch in batches:
        if isinstance(batch, pa.RecordBatch):
            yield from (batch.slice(start, rows) for start in range(0, batch.num_rows, rows))
            continue
        for start in range(0, len(batch), rows):
            yield batch.iloc[start : start + rows]


Kernel = Callable[[Batch], tuple]


def scan_top_k(
    corpus: DataFrame,
    queries: DataFrame,
    kernel_of: Callable[[list[Row]], Kernel],
    k: int,
    max_block_queries: int = MAX_BLOCK_QUERIES,
    extras: dict[str, str] | None = None,
    arrow: bool = False,
    pairs: bool = False,
) -> DataFrame:
    """(query_id, chunk_id, score, position): the k best corpus rows per query.

    `kernel_of(block)` builds the scorer of a query block; it maps a batch of corpus rows to a
    scores matrix (rows x queries), an eligibility mask and, for the columns named in `extras`
    (name to type), further matrices that are carried along. With `arrow` a batch is a record batch.

    With `pairs` it maps a batch and the queries' floors to the (row, query) positions that may reach their floor, their
    rounded scores and the further values, all as flat arrays; queries may bring a `floor` that k of their rows reach.
    """
    types = dict(corpus.dtypes), dict(queries.dtypes)
    schema = f"query_id {types[1]['query_id']}, chunk_id {types[0]['chunk_id']}, score double"
    extras = extras or {}
    schema += "".join(f", {name} {kind}" for name, kind in extras.items())

    def pass_over(block: list[Row]) -> DataFrame:
        kernel = kernel_of(block)
        ids = np.array([row["query_id"] for row in block])
        given = np.array([row["floor"] if "floor" in row and row["floor"] is not None else -np.inf for row in block])

        def scan(batches: Iterator[Batch]) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []
            n_held, floors = 0, given.copy()
            for batch in slices(batches, len(block), PAIR_ROWS if pairs else None):
                if pairs:
                    rows, columns, values, *carried = kernel(batch, floors)
                    kept = values >= floors[columns]
                    rows, columns, values, carried = rows[kept], columns[kept], values[kept], [m[kept] for m in carried]
                else:
                    scores, eligible, *carried = kernel(batch)
                    rows, columns, values = rows_to_hold(scores, eligible, floors, k)
                    carried = [m[rows, columns] for m in carried]
                if not len(rows):
                    continue
                found = pd.DataFrame(
                    {
                        "query_id": ids[columns],
                        "chunk_id": column_of(batch, "chunk_id")[rows],
                        "score": values,
                        **dict(zip(extras, carried, strict=True)),
                    }
                )
                held.append(found)
                n_held += len(found)
                # Sorting costs more than scoring: rows are held until there are as many again as can be kept.
                if n_held > 2 * k * len(block):
                    held = [keep_best(pd.concat(held), k)]
                    n_held, floors = len(held[0]), np.maximum(given, full_floors(held[0], ids, k))
            if held:
                yield keep_best(pd.concat(held), k)

        def scan_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for found in scan(batches):
                yield pa.RecordBatch.from_pandas(found, preserve_index=False)

        return corpus.mapInArrow(scan_arrow, schema) if arrow else corpus.mapInPandas(scan, schema)

    passes = [pass_over(block) for block in query_blocks(queries, "query_id", max_block_queries)]
    hits = reduce(DataFrame.unionByName, passes)
    return top_k(hits, ["query_id"], [F.desc("score"), "chunk_id"], k, into="position")
