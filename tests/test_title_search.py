from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import fuzzy, scan


def test_only_similar_sizes_are_counted_and_none_is_lost():
    """every trigram set was compared with every query, however different their sizes."""
    rng = random.Random(3)
    sets = lambda n, low, high: [rng.sample(range(60), rng.randint(low, high)) for _ in range(n)]
    queries, lists = [*sets(300, 1, 30), []], [*sets(500, 0, 40), []]
    index = fuzzy.GramQueries(queries)
    held = fuzzy.GramLists(pa.array(lists, pa.list_(pa.int64())), index.words)
    least = np.array([rng.choice([0.1, 0.3, 0.7, 1.0, 1.5]) for _ in queries])
    want = {}
    for i, grams in enumerate(lists):
        for j, own in enumerate(queries):
            similar = len(set(grams) & set(own)) / max(len(set(grams) | set(own)), 1)
            if similar >= least[j]:
                want[i, j] = round(similar, 6)
    found = {(i, j): s for rows, columns, values in index.hopeful(held, least) for i, j, s in zip(rows, columns, values, strict=True)}
    assert want and set(want) <= set(found) and all(found[p] == pytest.approx(s) for p, s in want.items())
    rows, columns = (np.array(x) for x in zip(*sorted(want), strict=True))
    assert index.similarity(held, rows, columns) == pytest.approx([want[p] for p in sorted(want)])


def test_floors_change_no_answer(spark, monkeypatch):
    """with more queries than a block, records are scanned with a floor from some of them; answers stay those of all pairs."""
    rng = random.Random(7)
    words = ["alpha", "beta", "gämma", "delta", "eps", "名前", "𝒳yz", "theta"]
    some = lambda n: " ".join(rng.choices(words, k=n))
    rows = [
        (f"p{n:03}", f"kb{n % 3}", some(rng.randint(1, 6)), rng.choice(["alpha", f"alpha-beta-{n}", f"s{n}"]), some(rng.randint(0, 12)), [some(rng.randint(1, 2)) for _ in range(n % 4)])
        for n in range(150)
    ]
    pages = spark.createDataFrame(rows, "page_id string, kb_id string, title string, slug string, summary string, aliases array<string>").repartition(5)
    asked = [(q, some(rng.randint(1, 5)).lower(), ["kb1"] if q % 5 == 0 else None) for q in range(40)]
    queries = spark.createDataFrame(asked, "query_id long, query string, scope array<string>")
    alone = sorted(map(str, fuzzy.metadata_top_k(pages, queries, 6).collect()))
    seeds, whole = [], fuzzy.with_floors
    monkeypatch.setattr(scan, "MAX_BLOCK_QUERIES", 16)
    monkeypatch.setattr(fuzzy, "FLOOR_RECORDS", 60)
    monkeypatch.setattr(fuzzy, "FLOOR_ROWS", 25)
    monkeypatch.setattr(fuzzy, "with_floors", lambda *given: seeds.append(whole(*given)) or seeds[-1])
    got = fuzzy.metadata_top_k(pages, queries, 6)
    assert sorted(map(str, got.collect())) == alone
    floors = {r.query_id: r.floor for r in seeds[0].collect()}
    assert any(x is not None for x in floors.values())
    similar = lambda field: T.trigram_similarity(T.trigrams(F.col(field)), T.trigrams(F.col("query")))
    best = F.coalesce(F.array_max(F.transform("aliases", lambda a: T.trigram_similarity(T.trigrams(a), T.trigrams(F.col("query"))))), F.lit(0.0))
    slug = F.replace(F.col("query"), F.lit(" "), F.lit("-"))
    named = (F.lower("title") == F.col("query")) | (F.lower("slug") == slug) | F.exists("aliases", lambda a: F.lower(a) == F.col("query"))
    pairs = pages.crossJoin(queries).where("scope is null or array_contains(scope, kb_id)").withColumn(
        "relevance", F.round(F.greatest(similar("title"), similar("summary"), best), 6)
    )
    prefix = F.startswith(F.lower("slug"), slug)
    pairs = pairs.where((F.col("relevance") > 0.1) | prefix).withColumn("score", F.col("relevance") + 4 * named.cast("int") + 2 * prefix.cast("int"))
    want = {}
    for r in pairs.collect():
        want.setdefault(r.query_id, []).append((-round(r.score, 6), r.page_id))
    assert {(r.query_id, r.page_id) for r in got.collect()} == {(q, p) for q, found in want.items() for _, p in sorted(found)[:6]}
    for query, floor in floors.items():
        assert floor is None or floor <= -sorted(want[query])[5][0] + 1e-9
