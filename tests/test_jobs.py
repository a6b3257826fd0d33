from __future__ import annotations

import io
import json
import tempfile
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusloom import plugins, tools
from corpusloom.functions import replies
from corpusloom.operators import chunking
from corpusloom.plans import evaluate, ingest, integrity, retrieve, wiki_build, wiki_search
from corpusloom.schemas import MODEL
from corpusloom.sources import store, tables, uploads, version_table, wiki_tables
from corpusloom.streaming import streams


def docx(names):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for name in names:
            archive.writestr(name, "x")
    return buffer.getvalue()


DOCX = uploads.MIME_BY_SUFFIX[".docx"]


@pytest.mark.parametrize(
    ("name", "mime", "content", "code"),
    [
        ("a.exe", "text/plain", b"x", "unsupported_file_type"),
        ("a.txt", "text/html", b"x", "unsupported_media_type"),
        ("a.txt", "text/plain; charset=utf-8", b"", "empty_file"),
        ("a.txt", "TEXT/PLAIN", b"x" * 101, "file_too_large"),
        ("a.pdf", "application/pdf", b"PDF", "invalid_file_signature"),
        ("a.pdf", "application/pdf", b"%PDF-1.7", None),
        ("a.docx", DOCX, b"no zip", "invalid_file_signature"),
        ("a.md", "text/markdown", b"\xff\xfe", "invalid_text_encoding"),
        ("a.md", "text/markdown", "策略".encode(), None),
    ],
)
def test_upload_codes(spark, name, mime, content, code):
    df = spark.createDataFrame([(name, mime, bytearray(content))], "filename string, declared_mime string, content binary")
    row = uploads.validate(df, 100).first()
    assert row["code"] == code
    if code is None:
        import hashlib

        assert row["sha256"] == hashlib.sha256(content).hexdigest()
        assert (row["title"], row["size"]) == ("a", len(content))


def test_docx_container(spark):
    good = docx(["[Content_Types].xml", "word/document.xml"])
    rows = [("a.docx", DOCX, bytearray(good)), ("b.docx", DOCX, bytearray(docx(["x"])))]
    df = spark.createDataFrame(rows, "filename string, declared_mime string, content binary")
    assert {r["filename"]: r["code"] for r in uploads.validate(df).collect()} == {"a.docx": None, "b.docx": "invalid_file_signature"}


def test_file_scan_reads_only_accepted_kinds(spark, tmp_path):
    for name in ("a.md", "b.txt", "c.png"):
        (tmp_path / name).write_text("x")
    found = uploads.scan_files(spark, str(tmp_path)).select("path").collect()
    assert sorted(r["path"].rsplit("/", 1)[-1] for r in found) == ["a.md", "b.txt"]


def test_markdown_sections_keep_the_heading_trail(spark):
    text = "---\ntitle: x\n---\nintro\n# A\none\n## B ##\n\ntwo\nmore\n### C\n## D\nthree\n# E\n"
    df = spark.createDataFrame([(text,)], "text string").select(uploads.markdown_sections(F.col("text")).alias("s"))
    rows = [(r["section_no"], list(r["heading_path"]), r["text"]) for r in df.first()["s"]]
    assert rows == [(0, [], "intro"), (1, ["A"], "one"), (2, ["A", "B"], "two\nmore"), (3, ["A", "D"], "three")]


def test_html_and_plain_sections(spark):
    html = "<head><title>t</title></head><h1>Top</h1><p>a &amp; b<script>x</script></p><h2>Sub</h2><div>c</div>"
    df = spark.createDataFrame([(html, " plain ", " ")], "h string, p string, e string")
    row = df.select(
        uploads.html_sections(F.col("h")).alias("h"),
        plugins.sections_by_suffix(F.lit(".txt"), F.col("p")).alias("p"),
        uploads.parse_status(chunking.whole_text_section(F.col("e"))).alias("e"),
    ).first()
    assert [(list(s["heading_path"]), s["text"]) for s in row["h"]] == [(["Top"], "a & b"), (["Top", "Sub"], "c")]
    assert [s["text"] for s in row["p"]] == ["plain"]
    assert row["e"] == "document_parse_failed"


def test_chunk_invariants(spark, folder):
    chunks = tables.chunks(spark, folder)
    bad = chunks.groupBy("version_id").agg(
        F.max("ordinal").alias("top"), F.count(F.lit(1)).alias("n"), F.count_distinct("ordinal").alias("d")
    ).where("top + 1 <> n OR n <> d")
    assert bad.count() == 0
    assert chunks.where((F.col("kind") == "child") & (F.length("content") > 200)).count() == 0


SINK = "version_id string, chunk_id string"


def sink_rows(spark, path):
    return {tuple(r) for r in version_table.read(spark, path).select("version_id", "chunk_id").collect()}


def test_sinks_replace_only_changed_versions(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = [(f"v{n}", f"c{n}-{i}") for n in range(6) for i in range(3)]
    version_table.create(spark.createDataFrame(rows, SINK), path, 4)
    before = version_table.commit_at(spark, path).live
    changed = spark.createDataFrame([("v1",), ("v9",)], "version_id string")
    new = spark.createDataFrame([("v1", "new"), ("v9", "first")], SINK)
    for _ in range(2):
        version_table.replace(new, changed, path)
        assert sink_rows(spark, path) == {r for r in rows if r[0] != "v1"} | {("v1", "new"), ("v9", "first")}
    after = version_table.commit_at(spark, path).live
    assert any(after.get(b) == g for b, g in before.items()) and after != before


def test_sinks_delete_the_last_version_of_a_bucket(spark, tmp_path):
    path = f"{tmp_path}/t"
    version_table.create(spark.createDataFrame([("v1", "a"), ("v2", "b")], SINK), path, 64)
    for left in ({("v2", "b")}, {("v2", "b")}, set()):
        gone = "v1" if left else "v2"
        version_table.delete(spark.createDataFrame([(gone,)], "version_id string"), path)
        assert sink_rows(spark, path) == left


def test_sinks_bound_files_of_a_hot_version(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(version_table, "BUCKET_ROWS", 50)
    monkeypatch.setattr(version_table, "FILE_ROWS", 20)
    path = f"{tmp_path}/t"
    version_table.create(spark.createDataFrame([("hot" if n % 3 else f"v{n}", str(n)) for n in range(300)], SINK), path)
    assert version_table.commit_at(spark, path).buckets == 6
    files = version_table.read(spark, path).groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in files) <= 20 and sum(r["count"] for r in files) == 300


def test_a_write_broken_before_its_commit_leaves_the_old_state(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    version_table.create(spark.createDataFrame([("v1", "a"), ("v2", "b")], SINK), path, 2)
    gone = spark.createDataFrame([("v1",)], "version_id string")

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(version_table, "_publish", broken)
        with pytest.raises(OSError, match="lost"):
            version_table.replace(spark.createDataFrame([("v1", "new")], SINK), gone, path)
    assert sink_rows(spark, path) == {("v1", "a"), ("v2", "b")}
    version_table.delete(gone, path)
    version_table.vacuum(spark, path)
    assert sink_rows(spark, path) == {("v2", "b")} and version_table.commits(spark, path) == [1]
    with pytest.raises(ValueError, match="version_table_not_found"):
        version_table.read(spark, path, 0)


def test_the_second_of_two_writers_fails(spark, tmp_path):
    path = f"{tmp_path}/t"
    version_table.create(spark.createDataFrame([("v1", "a")], SINK), path, 2)
    stale = version_table.commit_at(spark, path)
    version_table.delete(spark.createDataFrame([("v1",)], "version_id string"), path)
    with pytest.raises(RuntimeError, match="version_table_changed"):
        version_table._publish(spark, path, version_table.Commit(stale.number + 1, stale.schema, 2, stale.live))
    assert sink_rows(spark, path) == set()


def test_store_round_trip(spark):
    root = tempfile.mkdtemp(prefix="store-")
    df = spark.createDataFrame([("p1", "k", "s", "topic", "T", "v", False)], MODEL["wiki_pages"])
    store.write_table(df, root, "wiki_pages")
    assert store.read_table(spark, root, "wiki_pages").collect() == df.collect()


def test_no_returned_source_is_hidden_or_over_budget(spark, folder):
    sources = entry.queries()["search_sources_budgeted"](spark, folder).cache()
    dim = tables.documents_dim(spark, folder)
    shown = sources.join(dim.select("doc_id", "kb_id", "deleted", "active_version_id"), "doc_id")
    wrong = shown.where("deleted OR active_version_id <> version_id OR kb_id IN ('src7', 'src13')")
    assert sources.count() > 0 and wrong.count() == 0
    assert sources.where(F.length("excerpt") > 500).count() == 0
    assert sources.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("r")).where("n <> r OR n > 8").count() == 0


def test_excerpt_budget_stops(spark):
    rows = [(1, f"c{n}", f"p{n // 2}", n + 1, "x" * 600) for n in range(120)]
    df = spark.createDataFrame(rows, "query_id long, chunk_id string, parent_chunk_id string, position int, content string")
    found = retrieve.sources(df, deduplicate_parents=False)
    assert found.count() == 48
    assert found.agg(F.sum(F.length("excerpt"))).first()[0] == 24_000
    assert retrieve.sources(df, deduplicate_parents=True).count() == 48


def test_rerank_falls_back_per_query(spark):
    rows = [(1, "a", 1, 0.1), (1, "b", 2, 0.9), (2, "c", 1, None), (2, "d", 2, 0.5)]
    df = spark.createDataFrame(rows, "query_id long, chunk_id string, rank int, s double")
    got = retrieve.rerank(df, F.col("s"), 8).orderBy("query_id", "rank").collect()
    assert [(r["chunk_id"], r["degraded"]) for r in got] == [("b", False), ("a", False), ("c", True), ("d", True)]


def test_failing_scorer_gives_null(spark):
    def score(query, passage):
        if passage == "bad":
            raise RuntimeError
        return 2.0

    df = spark.createDataFrame([("q", "bad"), ("q", "ok")], "q string, p string")
    got = df.select("p", plugins.pair_scorer(score)(F.col("q"), F.col("p")).alias("s")).collect()
    assert {r["p"]: r["s"] for r in got} == {"bad": None, "ok": 2.0}


def wiki_corpus(spark, texts):
    """Searchable pages with one claim per text, every claim on its own valid chunk."""
    pages = spark.createDataFrame(
        [(p, "k", f"slug-{p}", "summary", f"title {p}", "", [], True, True) for p in texts],
        "page_id string, kb_id string, slug string, page_type string, title string, summary string, "
        "aliases array<string>, enabled boolean, wiki_enabled boolean",
    )
    facts = [(p, "k", f"{p}-{n}", t, n, "summary_fact", f"chunk-{p}-{n}", 1) for p, ts in texts.items() for n, t in enumerate(ts)]
    evidence = spark.createDataFrame(
        facts, "page_id string, kb_id string, claim_id string, text string, position int, claim_type string, chunk_id string, doc_id long"
    )
    return pages, evidence


def search(spark, texts, query, sources, **limits):
    pages, evidence = wiki_corpus(spark, texts)
    queries = wiki_search.valid_queries(spark.createDataFrame([(1, query)], "query_id long, text string"))
    found = spark.createDataFrame([(1, c, n) for n, c in enumerate(sources, 1)], "query_id long, chunk_id string, rank int")
    rows = wiki_search.search(queries, pages, evidence, found, **limits).orderBy("page_order", "claim_rank").collect()
    return [(r["page_id"], r["claim_id"]) for r in rows], {r["truncation_reason"] for r in rows}, rows


def test_character_budget_keeps_the_first_claim_and_counts_the_rest(spark):
    texts = {"p": ["vpn " + "a" * 41, "vpn " + "b" * 41, "vpn " + "c" * 41, "vpn " + "d" * 41]}
    got, reasons, rows = search(spark, texts, "vpn", [f"chunk-p-{n}" for n in range(4)], character_budget=50)
    assert got == [("p", "p-0")] and reasons == {"character_budget"}
    assert rows[0]["omitted_claim_count"] == 3


def test_too_long_first_claim_is_admitted_only_while_nothing_matched(spark):
    texts = {"a": ["vpn " + "x" * 100], "b": ["vpn " + "y" * 100], "c": ["vpn"]}
    got, reasons, _ = search(spark, texts, "vpn", ["chunk-a-0", "chunk-b-0", "chunk-c-0"], character_budget=110)
    assert got == [("a", "a-0"), ("c", "c-0")]
    assert reasons == {"character_budget"}


def test_reaching_the_page_limit_reports_the_claim_limit(spark):
    texts = {p: [f"vpn {p}"] for p in "abc"}
    got, reasons, _ = search(spark, texts, "vpn", [f"chunk-{p}-0" for p in "abc"], page_limit=2)
    assert len(got) == 2 and reasons == {"claim_limit"}


def test_claim_cap_per_page(spark):
    many = [f"vpn word{n}" for n in range(9)]
    one, _, _ = search(spark, {"a": many}, "vpn", ["chunk-a-0"])
    two, _, _ = search(spark, {"a": many, "b": many}, "vpn", ["chunk-a-0", "chunk-b-0"])
    assert len(one) == 9
    assert [p for p, _ in two] == ["a"] * 4 + ["b"] * 4


def test_without_sources_metadata_still_finds_pages(spark):
    got, _, rows = search(spark, {"remote": ["vpn access"]}, "title remote", [])
    assert got == [("remote", "remote-0")] and rows[0]["matched_fields"][0] == "title"


def reranked(spark, texts, sources, reranker, failures=None):
    pages, evidence = wiki_corpus(spark, texts)
    asked = wiki_search.valid_queries(spark.createDataFrame([(1, "vpn"), (2, "nothing here")], "query_id long, text string"))
    found = spark.createDataFrame([(1, c, n) for n, c in enumerate(sources, 1)], "query_id long, chunk_id string, rank int")
    lost = None if failures is None else spark.createDataFrame(failures, "query_id long, reason string")
    rows, status = wiki_search.search_with_status(asked, pages, evidence, found, reranker=reranker, source_failures=lost)
    order = [r["page_id"] for r in rows.orderBy("page_order", "claim_rank").collect()]
    return order, {r["query_id"]: r for r in status.collect()}


def test_page_reranker_orders_pages_and_fails_per_query(spark):
    texts = {p: [f"vpn {p}"] for p in "abc"}
    sources = [f"chunk-{p}-0" for p in "abc"]
    order, status = reranked(spark, texts, sources, lambda query, passage: F.ascii(F.substring(passage, 7, 1)))
    assert order == ["c", "b", "a"] and not status[1]["degraded"]
    assert (status[2]["n_claims"], status[2]["truncation_reason"], status[2]["degraded"]) == (0, None, False)
    broken = lambda query, passage: F.when(~passage.contains("title b"), F.ascii(F.substring(passage, 7, 1)))
    order, status = reranked(spark, texts, sources, broken)
    assert order == ["a", "b", "c"] and status[1]["degradation_reason"] == "reranker_unavailable"
    order, status = reranked(spark, {"b": ["vpn b"]}, ["chunk-b-0"], broken)
    assert order == ["b"] and not status[1]["degraded"]  # one page needs no order


def test_failed_source_channel_degrades_and_comes_first(spark):
    texts = {p: [f"vpn {p}"] for p in "ab"}
    broken = lambda query, passage: F.lit(None).cast("double")
    sources = ["chunk-a-0", "chunk-b-0"]
    order, status = reranked(spark, texts, sources, broken, [(1, "source_retrieval_unavailable")])
    assert order == [] and status[1]["degradation_reason"] == "source_retrieval_unavailable"
    order, status = reranked(spark, texts, sources, broken, [(1, "source_reranker_unavailable"), (2, "source_retrieval_unavailable")])
    assert order == ["a", "b"] and status[1]["degradation_reason"] == "source_reranker_unavailable"
    assert status[2]["degradation_reason"] == "source_retrieval_unavailable"


def test_pages_without_claims_still_report_a_reason(spark):
    texts = {"a": ["vpn a"]}
    pages, evidence = wiki_corpus(spark, texts)
    asked = wiki_search.valid_queries(spark.createDataFrame([(1, "title a")], "query_id long, text string"))
    none = spark.createDataFrame([], "query_id long, chunk_id string, rank int")
    _, status = wiki_search.search_with_status(asked, pages, evidence.where("false"), none)
    assert [(r["n_claims"], r["truncation_reason"]) for r in status.collect()] == [(0, "claim_limit")]


def test_sources_of_a_claim_with_very_many(spark):
    found = spark.createDataFrame([(1, "p", "c"), (2, "p", "c"), (2, "p", "d")], "query_id long, page_id string, claim_id string")
    many = [("p", "c", f"chunk-{n:05}", n % 7) for n in range(3000)] + [("p", "d", "chunk-x", 1), ("p", "e", "chunk-y", 1)]
    evidence = spark.createDataFrame(many + many[:5], "page_id string, claim_id string, chunk_id string, doc_id long")
    rows = wiki_search.claim_sources(found, evidence).collect()
    assert len(rows) == 6001 and {r["claim_id"] for r in rows} == {"c", "d"}
    want = sorted((d, c) for _, k, c, d in many if k == "c")
    assert sorted((r["source_no"], r["doc_id"], r["chunk_id"]) for r in rows if r["query_id"] == 1) == [(n, *x) for n, x in enumerate(want, 1)]


def plain_walk(pages, page_limit, claim_limit, budget):
    """Claims (page, place) admitted claim by claim, and the reason, written as rules on the rows met so far."""
    per_page = claim_limit if len(pages) == 1 else 4
    kept, reason, left = [], None, budget
    for page, costs in enumerate(pages):
        matched = len({p for p, _ in kept})
        if left <= 0 and kept:
            return kept, "character_budget"
        if matched == page_limit or len(kept) == claim_limit:
            return kept, reason or "claim_limit"
        for place, cost in enumerate(costs):
            if sum(p == page for p, _ in kept) == per_page or len(kept) == claim_limit:
                break
            if kept and cost > left:
                reason = "character_budget"
                break
            kept.append((page, place))
            left = max(0, left - cost)
    matched = len({p for p, _ in kept})
    if left <= 0 and kept:
        return kept, "character_budget"
    if reason is None and matched < len(pages):
        reason = "page_limit" if matched >= page_limit else "claim_limit"
    return kept, reason


@pytest.mark.parametrize("page_limit, claim_limit, budget", [(5, 12, 60), (2, 3, 25), (1, 1, 1000), (20, 50, 1)])
def test_budget_fold_against_plain_rules(spark, page_limit, claim_limit, budget):
    import random

    from corpusloom.plans import wiki_budget

    rng = random.Random(page_limit)
    cases = [[[rng.randint(0, 20) for _ in range(rng.randint(0, 6))] for _ in range(rng.randint(1, 8))] for _ in range(60)]
    rows = []
    for n, pages in enumerate(cases):
        flat = [(p, c, at) for p, costs in enumerate(pages, 1) for at, c in (list(enumerate(costs)) or [(None, None)])]
        rows.append((n, flat))
    df = spark.createDataFrame(rows, "n int, rows array<struct<page_order:int,cost:int,at:int>>")
    got = df.withColumn("t", wiki_budget.admitted(F.col("rows"), page_limit, claim_limit, 4, budget)).collect()
    for r in got:
        kept, reason = plain_walk(cases[r["n"]], page_limit, claim_limit, budget)
        assert [(r["rows"][i - 1]["page_order"] - 1, r["rows"][i - 1]["at"]) for i in r["t"]["kept"]] == kept
        assert r["t"]["reason"] == reason


def test_invalid_wiki_query(spark):
    df = spark.createDataFrame([("%_---",), ("x" * 201,), (" ",), ("vpn",)], "text string")
    got = [r[0] for r in df.select(retrieve.query_status(F.col("text"), F.lit(5))).collect()]
    assert got == ["invalid_wiki_query"] * 3 + ["ok"]


def test_trust_needs_all_sources_search_needs_one(spark):
    claims = spark.createDataFrame([("a", "verified"), ("b", "verified"), ("c", "verified")], "claim_id string, trust_state string")
    checked = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "claim_id string, valid boolean")
    shown = {r["claim_id"]: r["displayed"] for r in integrity.displayed_trust(claims, checked).collect()}
    assert shown == {"a": "needs_review", "b": "verified", "c": "needs_review"}
    assert {r["claim_id"] for r in integrity.admissible_claims(claims, checked).collect()} == {"a", "b"}


def test_generation_calls(spark):
    df = spark.createDataFrame([(n,) for n in (1, 12, 13, 145)], "n long")
    got = [int(r[0]) for r in df.select(wiki_build.generation_calls(F.col("n"))).collect()]
    assert got == [1, 1, 3, 13 + 2 + 1]


def test_generator_plugin_numbers_sources_over_all_batches(spark):
    children = spark.createDataFrame(
        [(1, "v", "T", n, f"text {n}") for n in range(1, 15)], "doc_id long, version_id string, title string, child_index int, content string"
    )

    def generate(title, excerpts):
        claims = [{"text": "same", "source_indices": [index]} for index, _ in excerpts]
        return json.dumps({"summary_claims": claims, "topics": []}), None if excerpts[0][0] > 12 else 5

    told = plugins.generate_replies(children, generate).withColumn("parsed", replies.parsed(F.col("reply")))
    assert told.where(replies.reply_error(F.col("parsed"), F.lit(14)).isNotNull()).count() == 0
    drafts = told.select("doc_id", "version_id", "batch", F.posexplode(replies.reply_claims(F.col("parsed"))).alias("n", "c")).select(
        "doc_id", "version_id", (F.col("batch") * 100 + F.col("n")).alias("position"), "c.text", "c.source_indices"
    )
    merged = wiki_build.merge_claims(drafts).collect()
    assert [(r["text"], r["source_indices"]) for r in merged] == [("same", list(range(1, 15)))]
    assert told.agg(wiki_build.strict_total(F.col("measured_tokens"))).first()[0] is None


def test_evaluation_measures(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 4), (3, None)], "query_id long, rank int")
    row = evaluate.recall_and_mrr(ranks).first()
    assert (row["recall"], row["mrr"], row["top1"]) == (0.666667, 0.416667, 0.333333)


def test_tools_check_their_arguments(spark, folder):
    chunks = tables.chunks(spark, folder)
    corpus = tools.Corpus(
        chunks, tables.children(spark, folder), tables.document_vectors(spark, folder), tables.documents_dim(spark, folder),
        tables.knowledge_bases(spark, folder), wiki_tables.wiki_pages(spark, folder), wiki_tables.claims(spark, folder),
        wiki_tables.claim_sources(spark, folder),
    )
    calls = tables.queries(spark, folder).limit(3).unionByName(spark.createDataFrame([(99, "zzzzqq")], "query_id long, text string"))
    with pytest.raises(ValueError, match="invalid_search_options"):
        tools.search_knowledge(corpus, calls, limit=9)
    with pytest.raises(ValueError, match="document_or_chunk_required"):
        tools.read_document(corpus)
    with pytest.raises(ValueError, match="invalid_document_limit"):
        tools.list_documents(corpus, limit=21)
    cited, status = tools.search_knowledge(corpus, calls, mode="keyword", limit=2)
    got = {r["query_id"]: r["status"] for r in status.collect()}
    assert got[99] == "no_relevant_knowledge" and len(got) == 4
    assert cited.where("rank > 2").count() == 0
    found, told = tools.search_wiki(corpus, calls, mode="keyword")
    assert told.count() == 4 and found.where("claim_rank > 12").count() == 0


def split_input(df, parts):
    """A folder with the rows in several files written one after another."""
    path = tempfile.mkdtemp(prefix="stream-")
    for n in range(parts):
        df.where(F.col("part") == n).drop("part").coalesce(1).write.mode("append").parquet(path)
    return path


def test_events_are_consumed_once_over_batches_and_runs(spark):
    rows = [(f"k{n % 7}", "document.ingestion.requested" if n % 7 else "x", n, n // 10) for n in range(30)]
    df = spark.createDataFrame(rows, "event_key string, event_type string, s int, part int").withColumn(
        "ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s") * 3600)
    ).drop("s")
    path = split_input(df, 3)
    folder = streams.run_folder(spark, "test")
    schema = df.drop("part").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    streams.consume_events(stream, folder)
    streams.consume_events(spark.readStream.schema(schema).parquet(path), folder)
    got = spark.read.parquet(f"{folder}/events").collect()
    assert sorted(r["event_key"] for r in got) == [f"k{n}" for n in range(7)]
    assert {r["route"] for r in got if r["event_key"] == "k0"} == {"dead_letter"}
    assert sorted(r[0] for r in spark.read.parquet(f"{folder}/acknowledged").select("acknowledged").collect()) == [3, 10, 10]


def test_event_history_with_a_hot_key_and_a_crowded_bloom_table(spark, monkeypatch):
    # One word for all keys: every key passes the Bloom table, the history still decides.
    monkeypatch.setattr(streams, "BUCKETS", 2)
    monkeypatch.setattr(streams, "WORDS", 1)
    rows = [("hot" if n % 3 else f"k{n}", "x", n // 30) for n in range(90)] + [(None, "x", 2)]
    df = spark.createDataFrame(rows, "event_key string, event_type string, part int")
    folder = streams.run_folder(spark, "history")
    stream = spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(split_input(df, 3))
    streams.consume_events(stream, folder)
    keys = [r["event_key"] for r in spark.read.parquet(f"{folder}/events").collect()]
    assert sorted(keys) == sorted({k for k, _, _ in rows if k})
    told = {r["epoch"]: r["acknowledged"] for r in spark.read.parquet(f"{folder}/acknowledged").collect()}
    assert told == {0: 19, 1: 20, 2: 21}


@pytest.mark.parametrize("size", [1, 3, 9])
def test_fragment_filter_equals_whole_text(size):
    text = "see [1] and [9], [x] [12 [3] tail ["
    out, pending = "", ""
    for at in range(0, len(text), size):
        piece, pending = streams.filter_fragment(pending, text[at : at + size], 8)
        out += piece
    assert out + pending == "see [1] and , [x] [12 [3] tail ["


def test_long_open_bracket_is_flushed():
    piece, pending = streams.filter_fragment("", "a [" + "b" * 20, 8)
    assert piece == "a [" + "b" * 20 and pending == ""


FRAGMENTS = "message_id string, fragment_no long, fragment string, last boolean, second long, part int"


def filtered_messages(spark, rows, parts, delay="1 hour"):
    df = spark.createDataFrame(rows, FRAGMENTS).withColumn("sent_at", F.timestamp_seconds(F.col("second") + 1_700_000_000)).drop("second")
    folder = streams.run_folder(spark, "fragments")
    stream = spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(split_input(df, parts))
    streams.filter_citations(stream, folder, delay=delay)
    return {r["message_id"]: (r["text"], r["expired"]) for r in streams.whole_messages(spark, folder).collect()}


def test_citation_stream_keeps_state_between_batches(spark):
    parts = ["a [", "9] b [", "2] c"]
    rows = [("m", n, p, n == 2, n, n) for n, p in enumerate(parts)]
    assert filtered_messages(spark, rows, 3) == {"m": ("a  b [2] c", False)}


def test_late_and_repeated_fragments_are_put_in_order(spark):
    rows = [("m", 2, "2] c", True, 2, 0), ("m", 0, "a [", False, 0, 1), ("m", 0, "a [", False, 0, 1), ("m", 1, "9] b [", False, 1, 2)]
    rows += [("m", 1, "9] b [", False, 5, 3), ("n", 0, None, True, 5, 3)]
    assert filtered_messages(spark, rows, 4) == {"m": ("a  b [2] c", False), "n": ("", False)}


def test_messages_without_an_end_are_flushed_and_forgotten(spark):
    rows = [("lost", 0, "a [9", False, 0, 0), ("lost", 2, "] b [", False, 2, 0), ("open", 0, "x [1", False, 0, 0)]
    rows += [("next", 0, "z", True, 9000, 1), ("end", 0, "[1]", True, 9001, 2), ("lost", 1, "late", False, 1, 3)]
    got = filtered_messages(spark, rows, 4)
    assert got == {"lost": ("a  b [", True), "open": ("x [1", True), "next": ("z", False), "end": ("[1]", False)}


def test_incremental_ingest_adds_and_skips_failing_versions(spark):
    rows = [(f"v{n}", "k", ["one two", "three"] if n != 2 else [], n % 2) for n in range(4)]
    df = spark.createDataFrame(rows, "version_id string, kb_id string, lines array<string>, part int")
    path = split_input(df, 2)
    stream = spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(path)
    versions = stream.select(
        "version_id", "kb_id", chunking.line_sections(F.array_join("lines", "\n"), F.array("kb_id")).alias("sections")
    )
    folder = streams.run_folder(spark, "ingest-test")
    streams.ingest_versions(versions, folder, plugins.hash_embedder(8), 8, 4)
    got = {r["version_id"]: r["status"] for r in spark.read.parquet(f"{folder}/outcomes").collect()}
    assert got == {"v0": "ready", "v1": "ready", "v2": "failed", "v3": "ready"}
    assert spark.read.parquet(f"{folder}/index").groupBy("version_id").count().count() == 3


def test_tool_calls_are_refused_or_fail_one_by_one(spark, folder):
    index_root = tempfile.mkdtemp()
    from corpusloom.sources import search_index

    chunks = tables.chunks(spark, folder)
    index = search_index.build(chunks, (F.col("kind") == "child") & (F.col("version_status") == "ready"), f"{index_root}/index")
    docs, bases = tables.documents_dim(spark, folder), tables.knowledge_bases(spark, folder)
    corpus = tools.Corpus(index.chunks, tables.children(spark, folder), tables.document_vectors(spark, folder), docs, bases, index=index)
    rows = [(1, ["src1", "src2"], []), (2, ["src1"], ["src2"]), (3, ["src1", "src2"], ["src2"]), (4, None, []), (5, ["nowhere"], None)]
    text = tables.queries(spark, folder).first()["text"]
    calls = spark.createDataFrame([(i, text, t, r) for i, t, r in rows], "query_id long, text string, turn_scope array<string>, requested array<string>")
    cited, status = tools.search_knowledge(corpus, calls, mode="keyword")
    told = {r["query_id"]: r["status"] for r in status.collect()}
    assert told == {1: "ok", 2: "knowledge_scope_unavailable", 3: "ok", 4: "knowledge_scope_unavailable", 5: "no_relevant_knowledge"}
    assert {r["kb_id"] for r in cited.where("query_id = 3").collect()} == {"src2"}
    vector = tables.query_vectors(spark, folder).first()["vector"]
    vectors = spark.createDataFrame([(1, vector), (3, None)], "query_id long, vector array<float>")
    _, status = tools.search_knowledge(corpus, calls, vectors, mode="hybrid")
    told = {r["query_id"]: r["status"] for r in status.collect()}
    assert told == {
        1: "ok", 2: "knowledge_scope_unavailable", 3: "retrieval_unavailable",
        4: "knowledge_scope_unavailable", 5: "retrieval_unavailable",
    }


def test_failed_parse_and_stage_progress(spark):
    outcomes = spark.createDataFrame(
        [("a", None), ("b", "document_parse_failed"), ("c", "index_verification_failed")], "version_id string, error_code string"
    )
    got = {r["version_id"]: r["p"] for r in ingest.stage_rows(outcomes).groupBy("version_id").agg(F.max("progress").alias("p")).collect()}
    assert got == {"a": 100, "b": 10, "c": 75}


def test_every_query_has_a_statement():
    from corpusloom import catalog

    assert set(catalog.QUERIES) == set(catalog.SQL)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["stream_dedup_ingest", "stream_job_lifecycle", "stream_incremental_ingest"])
def test_streams_read_a_file_or_a_folder_of_parts(spark, folder, tmp_path, name):
    from corpusloom.catalog import QUERIES

    for table in ("events", "documents"):
        spark.read.parquet(f"{folder}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    rows = [sorted(map(str, QUERIES[name](spark, f).collect())) for f in (folder, str(tmp_path))]
    assert rows[0] and rows[0] == rows[1]


def test_topics_are_merged_where_their_documents_are(spark, folder):
    """Tokens are shuffled once, and a task's share of documents does not grow with the input."""
    from corpusloom.catalog import QUERIES

    plan = QUERIES["topic_merge"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(doc_id" in line and "ENSURE_REQUIREMENTS" in line]
    rows = spark.range(10).withColumnRenamed("id", "doc_id")
    tasks = [tables.by_document(rows, n).rdd.getNumPartitions() for n in (10, 10**6)]
    assert tasks == [int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(10**6) // tables.TASK_DOCUMENTS)]
