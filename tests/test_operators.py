from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import bm25, cells, chunking, components, containment, dense, fusion, mmr, ordering, scan
from corpusloom.plans import wiki_admin
from corpusloom.session import pinned


def fuse(spark, channels, k=60):
    rows = [("q", no, item, place) for no, items in enumerate(channels, 1) for place, item in enumerate(items, 1)]
    df = spark.createDataFrame(rows, "query_id string, channel int, item_id string, position int")
    return [(r["item_id"], r["score"]) for r in fusion.reciprocal_rank_fusion(df, k).orderBy("rank").collect()]


def test_fusion_order(spark):
    assert [item for item, _ in fuse(spark, [["a", "b"], ["b", "c"]])] == ["b", "a", "c"]


def test_fusion_counts_an_item_once_per_channel(spark):
    scores = dict(fuse(spark, [["a", "a", "b"]]))
    assert scores["a"] == pytest.approx(1 / 61, abs=1e-8)
    assert scores["b"] == pytest.approx(1 / 62, abs=1e-8)


def test_fusion_rejects_negative_k(spark):
    with pytest.raises(ValueError, match="invalid_rrf_k"):
        fuse(spark, [["a"]], k=-1)


def chunks_of(spark, sections, size):
    df = spark.createDataFrame([("v", sections)], "version_id string, text string")
    rows = chunking.chunk_rows(
        df.withColumn("sections", chunking.line_sections(F.col("text"), F.array(F.lit("h1"), F.lit("h2")))),
        child_characters=size,
    )
    return rows.orderBy("ordinal").collect()


def test_chunker_parents_and_children(spark):
    rows = chunks_of(spark, "  abcdefghijklmnopqr  ", 8)
    assert [r["kind"] for r in rows] == ["parent", "child", "child", "child"]
    assert "".join(r["content"] for r in rows[1:]) == rows[0]["content"] == "abcdefghijklmnopqr"
    assert [(r["char_start"], r["char_end"]) for r in rows] == [(0, 18), (0, 8), (8, 16), (16, 18)]
    assert rows[1]["embedding_text"] == "h1 > h2\nabcdefgh"
    assert [r["parent_ordinal"] for r in rows] == [None, 0, 0, 0]


def test_chunker_skips_blank_lines_and_counts_code_points(spark):
    rows = chunks_of(spark, "ab\n \n𝒳𝒴𝒵", 2)
    assert [(r["ordinal"], r["kind"], r["content"]) for r in rows] == [
        (0, "parent", "ab"), (1, "child", "ab"), (2, "parent", "𝒳𝒴𝒵"), (3, "child", "𝒳𝒴"), (4, "child", "𝒵"),
    ]


def hot_rows(spark, n=3000):
    """One group holds most of the rows."""
    return spark.range(n, numPartitions=7).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"),
        (F.col("id") * 7919 % n).alias("o"),
        (F.col("id") % 13 + 1).alias("v"),
    )


@pytest.fixture
def many_blocks(spark):
    """Keep small range partitions apart, as large ones are."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, "true")


def test_number_rows_and_running_sum_equal_windows(spark, many_blocks):
    from pyspark.sql import Window

    df = hot_rows(spark)
    window = Window.partitionBy("g").orderBy("o")
    expected = {
        (r["g"], r["o"]): (r["n"], r["s"])
        for r in df.select("g", "o", F.row_number().over(window).alias("n"), F.sum("v").over(window).alias("s")).collect()
    }
    numbers = ordering.number_rows(df, ["g"], ["o"]).collect()
    assert {(r["g"], r["o"]): r["row_no"] for r in numbers} == {k: v[0] for k, v in expected.items()}
    sums = ordering.running_sum(df, ["g"], ["o"], "v", "s").collect()
    assert {(r["g"], r["o"]): r["s"] for r in sums} == {k: v[1] for k, v in expected.items()}


def test_hot_group_is_spread_over_blocks(spark, many_blocks):
    blocks = ordering._row_blocks(hot_rows(spark), ["g"], ["o"]).where("g = 'hot'")
    assert blocks.select("_block").distinct().count() > 1


def test_with_previous_equals_lag(spark, many_blocks):
    from pyspark.sql import Window

    df = hot_rows(spark, 800)
    lag = df.select("g", "o", F.lag("v").over(Window.partitionBy("g").orderBy("o")).alias("p"))
    expected = {(r["g"], r["o"]): r["p"] for r in lag.collect()}
    told = ordering.with_previous(df, ["g"], ["o"], ["v"]).collect()
    assert {(r["g"], r["o"]): r["previous_v"] for r in told} == expected


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    parent = {n: n for edge in edges for n in edge}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        parent[b] = a
    df = spark.createDataFrame(edges, "u long, v long")
    found = {r["node"]: r["component"] for r in components.connected_components(df).collect()}
    assert found == {n: root(n) for n in parent}


def claim_rows(spark, groups):
    rows = [
        (q, page, f"c{no}", no, float(rel), tokens.split(), 3)
        for (q, page), claims in groups.items()
        for no, (rel, tokens) in enumerate(claims)
    ]
    schema = "query_id long, page_id string, claim_id string, seq int, relevance double, tokens array<string>, picks int"
    return pinned(spark.createDataFrame(rows, schema))


def picked(df):
    return sorted((r["query_id"], r["page_id"], r["pick"], r["claim_id"]) for r in df.collect())


def test_mmr_prefers_different_claims(spark):
    df = claim_rows(spark, {(1, "p"): [(1.0, "vpn mfa reset"), (0.98, "vpn mfa reset"), (0.8, "printer toner")]})
    assert [row[3] for row in picked(mmr.first_picks(df, "picks"))] == ["c0", "c2", "c1"]


def test_mmr_rounds_equal_single_task(spark):
    rng = random.Random(3)
    words = "a b c d e f g h".split()
    groups = {
        (q, f"p{p}"): [
            (rng.choice([0.0, 0.5, 1.0, 1.25]), " ".join(sorted(set(rng.choices(words, k=4))))) for _ in range(rng.randrange(1, 40))
        ]
        for q in range(3)
        for p in range(4)
    }
    df = claim_rows(spark, groups)
    assert picked(mmr.first_picks(df, "picks", group_limit=5)) == picked(mmr.first_picks(df, "picks"))


def test_mmr_rejects_bad_lambda(spark):
    with pytest.raises(ValueError, match="invalid_mmr_lambda"):
        mmr.first_picks(claim_rows(spark, {(1, "p"): [(1.0, "a")]}), "picks", lam=1.5)


def test_budget_waves_equal_sequential_fold(spark, many_blocks):
    rng = random.Random(11)
    jobs = [(kb, n, f"{kb}-{n}", rng.randrange(1, 60)) for kb in ("hot", "b") for n in range(300 if kb == "hot" else 20)]
    budgets = {"hot": 2500, "b": 200}
    expected = {}
    for kb in budgets:
        left = budgets[kb]
        for _, _, job, cost in [j for j in jobs if j[0] == kb]:
            expected[job] = cost <= left
            left -= cost if cost <= left else 0
    df = spark.createDataFrame(jobs, "kb_id string, job_order long, job_id string, estimate long")
    limits = spark.createDataFrame(list(budgets.items()), "kb_id string, remaining long")
    for fold_limit in (100_000, 25):
        rows = wiki_admin.admit_within_budget(df, limits, fold_limit).collect()
        assert {r["job_id"]: r["admitted"] for r in rows} == expected
        assert len(rows) == len(jobs)


DOCS = ["the cat sat", "the dog sat on the cat", "a bird", "the the the", "dog and bird and cat", ""]


def brute_bm25(query, docs):
    tokens = [doc.split() for doc in docs]
    average = sum(map(len, tokens)) / len(docs)
    scores = []
    for words in tokens:
        total = 0.0
        for term in set(query.split()):
            df = sum(term in t for t in tokens)
            tf = words.count(term)
            if tf:
                idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / average))
        scores.append(round(total, 6))
    return scores


@pytest.fixture(scope="module")
def index(spark):
    return spark.createDataFrame([(f"c{n}", f"k{n % 2}", d) for n, d in enumerate(DOCS)], "chunk_id string, kb_id string, content string")


def test_bm25_paths_agree_with_brute_force(spark, index):
    asked = {1: "the cat", 2: "bird dog", 3: "zebra"}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    expected = set()
    for q, text in asked.items():
        ranked = sorted(((s, f"c{n}") for n, s in enumerate(brute_bm25(text, DOCS)) if s > 0), key=lambda x: (-x[0], x[1]))
        expected |= {(q, c, s) for s, c in ranked[:3]}
    scanned = {(r["query_id"], r["chunk_id"], r["score"]) for r in bm25.keyword_search(index, queries, 3).collect()}
    assert scanned == expected
    key = lambda df: {(r["query_id"], r["chunk_id"], r["score"]) for r in df.collect()}
    assert key(bm25.keyword_search_on_postings(bm25.postings(index), queries, 3)) == expected
    scoped = queries.withColumn("scope", F.when(F.col("query_id") == 1, F.array(F.lit("k1"))))
    bases = index.select("kb_id").distinct().where("kb_id <> 'k0'")
    for given in (None, bases):
        stored = bm25.keyword_search_on_postings(bm25.postings(index), scoped, 3, given)
        assert key(stored) == key(bm25.keyword_search(index, scoped, 3, given))


def test_bm25_vocabulary_beyond_the_broadcast_bound(spark, index, monkeypatch):
    queries = spark.createDataFrame([(1, "the cat"), (2, "bird dog")], "query_id long, text string")
    known = sorted(map(tuple, bm25.keyword_search(index, queries, 3).collect()))
    monkeypatch.setattr(bm25, "MAX_BLOCK_TERMS", 1)
    assert sorted(map(tuple, bm25.keyword_search(index, queries, 3).collect())) == known


def test_bm25_scope_and_query_blocks(spark, index):
    queries = spark.createDataFrame([(n, "the cat dog bird", ["k1"] if n % 2 else None) for n in range(7)], "query_id long, text string, scope array<string>")
    asked = queries.withColumn("terms", T.token_set(F.col("text"))).drop("text")

    def kernel_of(block):
        return bm25.keyword_kernel(6, 3.0, {"the": 3, "cat": 3, "dog": 2, "bird": 2}, block)

    whole = scan.scan_top_k(bm25.with_terms(index), asked, kernel_of, 4)
    blocks = scan.scan_top_k(bm25.with_terms(index), asked, kernel_of, 4, max_block_queries=2)
    key = lambda df: sorted((r["query_id"], r["chunk_id"], r["score"], r["position"]) for r in df.collect())
    assert key(whole) == key(blocks)
    assert {r["chunk_id"] for r in whole.where("query_id % 2 = 1").collect()} <= {"c1", "c3", "c5"}


def test_semantic_search_equals_sql_form_and_lsh_finds_the_nearest(spark, folder):
    from corpusloom.sources import tables

    vectors, asked = tables.chunk_vectors(spark, folder), tables.query_vectors(spark, folder)
    exact = dense.semantic_search(vectors, asked, 5)
    pairs = asked.join(vectors.withColumnRenamed("vector", "other"), F.lit(True))
    slow = ordering.top_k(
        pairs.select("query_id", "chunk_id", F.round(dense.cosine(F.col("vector"), F.col("other")), 6).alias("score")),
        ["query_id"], [F.desc("score"), "chunk_id"], 5, into="position",
    )
    key = lambda df: sorted((r["query_id"], r["position"], r["chunk_id"], r["score"]) for r in df.collect())
    assert key(exact) == key(slow)
    near = dense.semantic_search_lsh(vectors, asked, 1, radius=1.0)
    assert all(r["query_id"] == r["chunk_id"] for r in near.collect())
    assert near.count() == asked.count()


def test_page_model_keeps_every_source_in_bounded_parts(spark):
    from corpusloom.plans import page_model

    pages = spark.createDataFrame([("hot", "s", "t"), ("small", "s2", "t2"), ("bare", "s3", "t3")], "page_id string, slug string, title string")
    facts = [(f"c{n:04}", "hot", f"text {n}", n % 40, "summary_fact", "verified") for n in range(230)]
    facts += [("d", "small", "one", 0, "summary_fact", "verified"), ("e", "small", "none", 0, "summary_fact", "verified")]
    claims = spark.createDataFrame(facts, "claim_id string, page_id string, text string, position int, claim_type string, trust_state string")
    cited = [(f"c{n:04}", n, "v", f"k{n}", 1, True) for n in range(230)] + [("d", n % 9, "v", f"x{n:04}", n, n != 7) for n in range(333)]
    checked = spark.createDataFrame(cited, "claim_id string, doc_id int, version_id string, chunk_id string, chunk_ordinal int, valid boolean")
    rows = page_model.page_model(pages, claims, checked, part_claims=20, part_sources=10).collect()
    assert all(len(r["claims"]) <= 20 and all(len(c["sources"]) <= 10 for c in r["claims"]) for r in rows)
    by = {}
    for r in sorted(rows, key=lambda r: r["part_no"]):
        by.setdefault(r["page_id"], []).extend(r["claims"])
    assert [c["claim_id"] for c in by["hot"]] == [f[0] for f in sorted(facts[:230], key=lambda f: (f[3], f[0]))]
    assert {c["trust_state"] for c in by["hot"]} == {"verified"} and by["bare"] == []
    split = [c for c in by["small"] if c["claim_id"] == "d"]
    assert [c["source_part"] for c in split] == list(range(34))
    assert [(s["doc_id"], s["chunk_id"]) for c in split for s in c["sources"]] == sorted((d, k) for c, d, _, k, _, _ in cited if c == "d")
    assert {(c["trust_state"], c["reason"], c["n_sources"]) for c in split} == {("needs_review", "source_not_current", 333)}
    assert by["small"][-1]["sources"] == [] and by["small"][-1]["reason"] == "source_not_current"


def test_generation_merges_across_batches_and_fails_whole_versions(spark):
    import json

    from corpusloom.plans import wiki_generate

    rows = [(d, f"v{d}", f"doc-{d}", n, f"chunk-{d}-{n}", "child", n, ["h"], f"text {n}") for d in (1, 2, 3) for n in range(1, 26)]
    children = spark.createDataFrame(
        rows, "doc_id long, version_id string, title string, child_index int, chunk_id string, kind string, ordinal int, heading_path array<string>, content string"
    )

    def generator(title, excerpts):
        first = excerpts[0][0]
        if title == "doc-2" and first == 13:
            return "{", 5
        claims = [{"text": "Shared  Fact", "source_indices": [first, 25, first]}, {"text": f"own {first}", "source_indices": [first]}]
        if title == "doc-3" and first == 25:
            claims[0]["source_indices"] = [26]
        topics = [{"name": f"t{i}", "aliases": ["t0", f"a{first}"], "source_indices": [first]} for i in range(7)]
        return "```json\n" + json.dumps({"summary_claims": claims, "topics": topics}) + "\n```", None if title == "doc-3" else first

    told = wiki_generate.generate(children, generator)
    outcomes = {r["doc_id"]: (r["n_batches"], r["code"], r["measured_tokens"]) for r in told.outcomes.collect()}
    assert outcomes == {1: (3, None, 39), 2: (3, "invalid_json", 31), 3: (3, "invalid_source", None)}
    claims = [(r["doc_id"], r["claim_no"], r["text"], r["source_indices"]) for r in told.claims.orderBy("claim_no").collect()]
    assert claims == [(1, 1, "Shared  Fact", [1, 25, 13]), (1, 2, "own 1", [1]), (1, 3, "own 13", [13]), (1, 4, "own 25", [25])]
    bound = {(r["claim_no"], r["source_no"]): r["chunk_id"] for r in told.sources.collect()}
    assert bound == {(1, 0): "chunk-1-1", (1, 1): "chunk-1-25", (1, 2): "chunk-1-13", (2, 0): "chunk-1-1", (3, 0): "chunk-1-13", (4, 0): "chunk-1-25"}
    topics = [(r["name"], r["aliases"]) for r in told.topics.orderBy("topic_no").collect()]
    assert topics == [("t0", ["a1", "a13", "a25"])] + [(f"t{i}", ["t0", "a1", "a13", "a25"]) for i in range(1, 5)]


@pytest.mark.parametrize("salt_rows", [40, 10**6])
def test_index_search_equals_the_scan(spark, tmp_path, salt_rows):
    """A word in every chunk, rare words, chunks without tokens, scopes, bases, ties, queries without a match."""
    from corpusloom.operators import bm25
    from corpusloom.sources import search_index

    rng = random.Random(3)
    rare = [f"rare{n}" for n in range(60)]
    texts = [" ".join(["the"] * rng.randint(1, 3) + rng.choices(["of", "and", "to"], k=rng.randint(0, 6)) + rng.choices(rare, k=rng.randint(0, 4))) for _ in range(900)]
    texts += ["", "...", texts[0], texts[1], texts[1]]
    chunks = spark.createDataFrame([(f"c{n:04}", f"kb{n % 5}", t) for n, t in enumerate(texts)], "chunk_id string, kb_id string, content string")
    parents = chunks.limit(3).withColumn("chunk_id", F.concat(F.lit("p"), "chunk_id"))
    marked = chunks.withColumn("child", F.lit(True)).unionByName(parents.withColumn("child", F.lit(False)))
    index = search_index.build(marked, F.col("child"), str(tmp_path / "index"), salt_rows)
    assert index.chunks.count() == len(texts) + 3 and index.counted.count() == len(texts)
    salted = index.table("terms").where("term = 'the'").first()
    assert salted["df"] == 903 and salted["salts"] == (23 if salt_rows == 40 else 1)
    asked = [(1, "the rare1 rare2", None), (2, "the of and", None), (3, "rare3", ["kb1", "kb2"]), (4, "nowhere", None), (5, "", None)]
    asked += [(10 + n, " ".join(["the", "of", *rng.sample(rare, 5)]), rng.choice([None, [], ["kb4"]])) for n in range(12)]
    queries = spark.createDataFrame(asked, "query_id long, text string, scope array<string>")
    bases = spark.createDataFrame([(f"kb{n}",) for n in (0, 1, 2, 4)], "kb_id string")
    for k, limited in ((3, None), (25, bases)):
        want = bm25.keyword_search(chunks, queries, k, limited).select("query_id", "chunk_id", "score", "position").collect()
        got = bm25.index_search(index, queries, k, limited).select("query_id", "chunk_id", "score", "position").collect()
        assert sorted(want) == sorted(got) and len(got) > 20


def test_index_search_by_chunks_and_by_postings(spark, tmp_path, monkeypatch):
    """Queries of frequent words are scored where the chunks lie: their postings are not read."""
    from corpusloom.operators import bm25
    from corpusloom.sources import search_index

    rng = random.Random(7)
    texts = [" ".join(rng.choices(["the", "of", "and", "to", "ab", "cd"], k=rng.randint(0, 12))) for _ in range(400)]
    chunks = spark.createDataFrame([(f"c{n:04}", f"kb{n % 3}", t) for n, t in enumerate(texts)], "chunk_id string, kb_id string, content string")
    index = search_index.build(chunks, F.lit(True), str(tmp_path / "index"), 50)
    asked = [(n, " ".join(rng.choices(["the", "of", "cd", "zz"], k=3)), rng.choice([None, [], ["kb1"]])) for n in range(9)]
    queries = spark.createDataFrame(asked, "query_id long, text string, scope array<string>")
    bases = spark.createDataFrame([("kb0",), ("kb1",)], "kb_id string")
    columns = ["query_id", "chunk_id", "score", "position"]
    for limited in (None, bases):
        want = sorted(bm25.keyword_search(chunks, queries, 10, limited).select(*columns).collect())
        assert sorted(bm25.index_search(index, queries, 10, limited, max_pairs=10**9).select(*columns).collect()) == want
        with monkeypatch.context() as patched:
            patched.setattr(bm25, "_matches", None)
            assert sorted(bm25.index_search(index, queries, 10, limited).select(*columns).collect()) == want


def test_equal_queries_are_scored_once(spark, monkeypatch):
    from corpusloom.operators import fuzzy

    pages = spark.createDataFrame(
        [(f"p{n:02}", "kb1" if n % 3 else "kb2", f"title {n % 4}", f"slug-{n}", "some words", [f"name {n % 5}"]) for n in range(20)],
        "page_id string, kb_id string, title string, slug string, summary string, aliases array<string>",
    )
    asked = [(1, "title 1", None), (2, "title 1", None), (3, "title 1", ["kb2"]), (4, "name 2", None), (5, "title 1", ["kb2"])]
    queries = spark.createDataFrame(asked, "query_id long, query string, scope array<string>")
    scored, whole = [], scan.scan_top_k
    with monkeypatch.context() as patched:
        patched.setattr(scan, "scan_top_k", lambda corpus, queries, *rest, **more: scored.append(queries.count()) or whole(corpus, queries, *rest, **more))
        rows = fuzzy.metadata_top_k(pages, queries, 4).collect()
    assert scored == [3]
    found = {q: sorted(tuple(r)[1:] for r in rows if r["query_id"] == q) for q, *_ in asked}
    assert found[1] == found[2] and found[3] == found[5] != found[1] and len(found[4]) == 4
    alone = fuzzy.metadata_top_k(pages, queries.where("query_id = 5"), 4).collect()
    assert found[5] == sorted(tuple(r)[1:] for r in alone)


def test_scan_sorts_only_what_may_stay(spark, monkeypatch):
    """Many small slices, ties and queries with few matches: the best rows are those of one sorted list."""
    import numpy as np

    rng = random.Random(5)
    values = [rng.randint(0, 30) for _ in range(400)]
    corpus = spark.createDataFrame([(f"c{n:04}", v) for n, v in enumerate(values)], "chunk_id string, value int").coalesce(1)
    queries = spark.createDataFrame([(1, 1), (2, 7), (3, 29)], "query_id long, step int")
    sorts = spark.sparkContext.accumulator(0)
    whole = scan.keep_best

    def counted(frame, k):
        sorts.add(1)
        return whole(frame, k)

    def kernel_of(block):
        steps = np.array([row["step"] for row in block])

        def kernel(batch):
            scores = batch["value"].to_numpy()[:, None] % (steps[None, :] + 1) + 0.0
            return scores, scores > 0

        return kernel

    monkeypatch.setattr(scan, "MAX_CELLS", 30)
    monkeypatch.setattr(scan, "keep_best", counted)
    got = scan.scan_top_k(corpus, queries, kernel_of, 5).select("query_id", "chunk_id", "score").collect()
    want = []
    for query, step in ((1, 1), (2, 7), (3, 29)):
        ranked = sorted((-(v % (step + 1)), f"c{n:04}") for n, v in enumerate(values) if v % (step + 1))
        want += [(query, chunk, float(-score)) for score, chunk in ranked[:5]]
    assert sorted(map(tuple, got)) == sorted(want)
    assert 0 < sorts.value < 40  # one sort for each of the 40 slices before


def test_postings_are_written_when_first_read(spark, tmp_path):
    from corpusloom.operators import bm25
    from corpusloom.sources import search_index

    texts = ["the cat and the dog", "the straße", "a cat cat cat"]
    rows = spark.createDataFrame([(f"c{i}", "k", text) for i, text in enumerate(texts)], "chunk_id string, kb_id string, content string")
    root = tmp_path / "index"
    index = search_index.build(rows, F.lit(True), str(root))
    asked = spark.createDataFrame([(1, "the cat a and dog")], "query_id long, text string")
    scanned = bm25.index_search(index, asked, 3, max_pairs=0).collect()
    assert not (root / "postings").exists()
    postings = index.table("postings").join(index.counted.select("chunk_no", "chunk_id"), "chunk_no")
    got = {(r["term"], r["chunk_id"]): r["tf"] for r in postings.collect()}
    want = {("the", "c0"): 2, ("cat", "c0"): 1, ("and", "c0"): 1, ("dog", "c0"): 1, ("the", "c1"): 1, ("strasse", "c1"): 1}
    assert got == want | {("a", "c2"): 1, ("cat", "c2"): 3}
    by_postings = bm25.index_search(index, asked, 3, max_pairs=10**9).select("query_id", "chunk_id", "score", "position")
    assert sorted(by_postings.collect()) == sorted((r["query_id"], r["chunk_id"], r["score"], r["position"]) for r in scanned)


def test_index_of_nothing(spark, tmp_path):
    from corpusloom.operators import bm25
    from corpusloom.sources import search_index

    none = spark.createDataFrame([], "chunk_id string, kb_id string, content string")
    index = search_index.build(none, F.lit(True), str(tmp_path / "index"))
    assert bm25.index_search(index, spark.createDataFrame([(1, "a")], "query_id long, text string"), 5).count() == 0


def grouped_vectors(spark, n, hot):
    """Vectors around twelve directions, a third of them around one; some without a direction or a vector."""
    draw = random.Random(3)
    middles = [[draw.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = []
    for i in range(n):
        middle = middles[0 if i % 3 == 0 and hot else i % 12]
        rows.append((i, f"b{i % 2}", [x + draw.gauss(0, 0.05) for x in middle]))
    rows += [(n, "b0", [0.0] * 16), (n + 1, "b1", None), (n + 2, "b0", rows[0][2])]
    return spark.createDataFrame(rows, "chunk_id long, kb_id string, vector array<double>")


def test_cell_search_equals_the_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "PART_ROWS", 40)
    monkeypatch.setattr(cells, "PART_QUERIES", 3)
    vectors = grouped_vectors(spark, 600, hot=True)
    index = cells.build(vectors, f"{tmp_path}/cells", 12)
    assert index.cells.agg(F.sum("n")).first()[0] == 602
    queries = vectors.where("chunk_id % 20 = 0 AND vector IS NOT NULL").select(
        F.col("chunk_id").alias("query_id"), "vector", F.when(F.col("chunk_id") % 40 == 0, F.array(F.lit("b1"))).alias("scope")
    )
    given = vectors.where("vector IS NOT NULL")

    def rows(df):
        return sorted(tuple(r) for r in df.select("query_id", "chunk_id", "score", "position").collect())

    expected = rows(dense.semantic_search(given, queries, 10))
    assert expected and rows(cells.search(index, queries, 10, probes=2)) == expected
    found = {}
    for probes in (2, 4):
        near = rows(cells.search(index, queries, 10, probes=probes, exact=False))
        found[probes] = len({r[:2] for r in near} & {r[:2] for r in expected}) / len(expected)
    print("recall by cells read", found)
    assert found[4] >= 0.9


def test_cell_search_without_rows(spark, tmp_path):
    vectors = grouped_vectors(spark, 3, hot=False)
    index = cells.build(vectors.where("false"), f"{tmp_path}/none")
    queries = vectors.select(F.col("chunk_id").alias("query_id"), "vector")
    assert cells.search(index, queries, 5).count() == 0
    only = cells.build(vectors.where("chunk_id = 3"), f"{tmp_path}/zero")
    assert {r["score"] for r in cells.search(only, queries, 5).collect()} == {0.0}
    single = cells.build(vectors.where("chunk_id = 1"), f"{tmp_path}/single")
    assert {r["query_id"]: r["score"] for r in cells.search(single, queries, 5).collect()}[1] == 1.0


def test_containment_equals_brute_force(spark, monkeypatch):
    """A run that a third of all texts share, passages cut inside words, short ones and repeated ids."""
    monkeypatch.setattr(containment, "BLOCK_ROWS", 3)
    rng = random.Random(8)
    words = ["ab", "b", "abc", "c", "", "x\ny", "caf\u00e9", "bb"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(120)]
    texts = [("all rights are reserved here " + t) if i % 3 == 0 else t for i, t in enumerate(texts)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, "another b text of three"), (200, None), (201, ""), (None, "ab")]
    asked = [(500, "rights are reserved here"), (501, "ights are reserved her"), (502, "no such words in any"), (503, None), (504, "")]
    for i in range(60):
        text = rng.choice(texts)
        at = rng.randrange(len(text))
        asked.append((i, text[at : at + rng.randint(1, 30)]))
    asked += [(0, "another b text"), (7, " "), (8, "b"), (None, "b")]
    got = containment.containing(
        spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    )
    want = {(q, d) for q, p in asked for d, t in docs if q is not None and d is not None and p and t and p in t}
    assert len(want) > 500
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == want


def test_containment_of_nothing(spark):
    queries = spark.createDataFrame([], "query_id long, text string")
    docs = spark.createDataFrame([(1, "some text of words")], "doc_id long, text string")
    assert containment.containing(queries, docs).count() == 0
    some = spark.createDataFrame([(1, "text of words"), (2, "of")], "query_id long, text string")
    assert containment.containing(some, docs.limit(0)).count() == 0


def test_index_counts_tokens_without_listing_them(spark, tmp_path, monkeypatch):
    """Words, single CJK characters, characters beside that range, null and empty texts; no list of tokens is made."""
    import re
    from collections import Counter

    from corpusloom.sources import search_index

    rng = random.Random(2)
    texts = ["".join(rng.choices("aB9z -\n_é中㐀鿿㏿ꀀ一😀ａAゖß", k=rng.randint(0, 30))) for _ in range(300)] + [None, "", "中", "a"]
    chunks = spark.createDataFrame([(f"c{n:04}", "kb", t) for n, t in enumerate(texts)], "chunk_id string, kb_id string, content string")
    with monkeypatch.context() as patched:
        patched.setattr(T, "terms", None)
        index = search_index.build(chunks, F.lit(True), str(tmp_path / "index"))
    folded = {r[0]: r[1] for r in chunks.select("chunk_id", T.fold(F.col("content"))).collect()}
    got = {r["chunk_id"]: r for r in index.counted.collect()}
    assert set(got) == {f"c{n:04}" for n, t in enumerate(texts) if t is not None}
    for chunk, row in got.items():
        want = Counter(re.findall("[a-z0-9]+|[㐀-鿿]", folded[chunk]))
        assert {t["term"]: t["tf"] for t in row["terms"]} == want and row["length"] == sum(want.values())


def test_scan_cuts_queries_one_by_one_only_where_many_rows_reach_the_floors(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    scores, floors = rng.random((200, 40)), np.full(40, 0.97)
    floors[7], eligible = -np.inf, rng.random((200, 40)) < 0.9
    eligible[:, 7] = np.arange(200) < 3
    with monkeypatch.context() as patched:
        patched.setattr(scan, "best_rows", None)
        rows, columns, values = scan.rows_to_hold(scores, eligible, floors, 5)
    whole = scan.rounded(scores)
    at = np.nonzero(eligible & (whole >= floors))
    assert set(zip(rows, columns, values, strict=True)) == set(zip(*at, whole[at], strict=True)) and len(rows) > 3
    assert len(scan.rows_to_hold(scores, eligible, np.full(40, -np.inf), 5)[0]) == 39 * 5 + 3


def test_scopes_are_decided_once_for_each_base():
    import numpy as np

    bases = np.array(["a", "b", None, "a", "c"], dtype=object)
    got = scan.allowed_matrix([None, ["a"], [], ["c", "b"]], bases)
    assert got.T.tolist() == [[True] * 5, [True, False, False, True, False], [False] * 5, [False, True, False, False, True]]


def test_evidence_compares_only_chunks_its_claims_name(spark, monkeypatch):
    from corpusloom.plans import integrity

    pages = [("1", "kb1", True, True), ("2", "kb1", True, False), ("3", "kb2", False, True), ("5", "kb1", True, True)]
    claims = [(f"c{d}-{n}", str(d), f"text {n}", n, "fact", "verified" if n < 2 else "needs_review") for d in range(1, 6) for n in range(3)]
    sources = [(f"c{d}-{n}", d, f"{d}-v1", f"{d}-{n}", "child", n, T.sha256_hex(F.lit(""))) for d in range(1, 6) for n in range(3)]
    digests = {f"{d}-{n}": f"body {d} {n}" for d in range(1, 6) for n in range(3)}
    chunks = spark.createDataFrame([(f"{d}-v1", "child", n, f"{d}-{n}", digests[f"{d}-{n}"]) for d in range(1, 6) for n in range(3)],
                                   "version_id string, kind string, ordinal int, chunk_id string, content string")
    told = spark.createDataFrame([row[:6] + (digests[row[3]] if row[5] else "drifted",) for row in sources],
                                 "claim_id string, doc_id long, version_id string, chunk_id string, chunk_kind string, chunk_ordinal int, body string")
    told = told.withColumn("content_sha256", T.sha256_hex(F.col("body"))).drop("body")
    documents = [(d, "kb2" if d == 3 else "kb9" if d == 5 else "kb1", False, "ready", f"{d}-v1") for d in range(1, 6)]
    compared, whole = [], integrity.chunk_digests
    with monkeypatch.context() as patched:
        patched.setattr(integrity, "chunk_digests", lambda rows: compared.append(rows.count()) or whole(rows))
        got = integrity.current_evidence(
            spark.createDataFrame(pages, "page_id string, kb_id string, enabled boolean, wiki_enabled boolean"),
            spark.createDataFrame(claims, "claim_id string, page_id string, text string, position int, claim_type string, trust_state string"),
            told,
            spark.createDataFrame(documents, "doc_id long, kb_id string, deleted boolean, status string, active_version_id string"),
            chunks,
        ).collect()
    assert [(r["page_id"], r["kb_id"], r["claim_id"], r["chunk_id"], r["doc_id"]) for r in got] == [("1", "kb1", "c1-1", "1-1", 1)]
    assert compared == [3]


def test_narrow_records_are_dealt_over_the_cores(spark, monkeypatch):
    from corpusloom.operators import fuzzy

    pages = spark.createDataFrame(
        [(f"p{n:02}", "kb1", f"title {n % 4}", f"title-{n}", "some words", [f"name {n % 5}"]) for n in range(40)],
        "page_id string, kb_id string, title string, slug string, summary string, aliases array<string>",
    ).coalesce(1)
    queries = spark.createDataFrame([(1, "title 1"), (2, "name 2"), (3, "title")], "query_id long, query string")
    parts, whole = [], scan.scan_top_k
    with monkeypatch.context() as patched:
        patched.setattr(scan, "scan_top_k", lambda corpus, *rest, **more: parts.append(corpus.rdd.getNumPartitions()) or whole(corpus, *rest, **more))
        rows = fuzzy.metadata_top_k(pages, queries, 4).collect()
    assert parts == [spark.sparkContext.defaultParallelism]
    assert sorted(r["page_id"] for r in rows if r["query_id"] == 1) == ["p01", "p05", "p13", "p17"]


def test_topics_lie_by_version_and_are_not_dealt_again(spark, monkeypatch):
    from collections import Counter

    from corpusloom.sources import wiki_tables

    rng = random.Random(4)
    words = [f"{c * 5}word" for c in "abcdefgh"] + ["short"]
    rows = [("kb1" if d < 20 else "kb2", d, f"{d}-v1", f"{d}/{n}", n, rng.choice(words)) for d in range(30) for n in range(8) for _ in range(rng.randint(0, 4))]
    tokens = spark.createDataFrame(rows, "kb_id string, doc_id long, version_id string, chunk_id string, child_index int, token string")
    monkeypatch.setattr(wiki_tables, "long_tokens", lambda spark, folder: tokens.repartition(6, "version_id"))
    mentions = wiki_tables.topic_mentions(spark, "tokens of a test")
    assert mentions._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    want = {}
    for doc in {row[1] for row in rows}:
        counted = Counter(row[5] for row in rows if row[1] == doc)
        for rank, (name, _) in enumerate(sorted(counted.items(), key=lambda item: (-item[1], item[0]))[:5], 1):
            want[doc, name] = rank, sorted({row[3] for row in rows if row[1] == doc and row[5] == name})
    got = mentions.collect()
    assert {(r["doc_id"], r["name"]): (r["rank"], sorted(r["chunk_ids"])) for r in got} == want and len(got) == len(want)
    pairs = {(r["doc_id"], r["name"], r["chunk_id"]) for r in wiki_tables.topic_sources_of(mentions).collect()}
    assert pairs == {(doc, name, chunk) for (doc, name), (_, chunks) in want.items() for chunk in chunks}
