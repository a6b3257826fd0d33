"""Each operator against a brute-force version, an exact round trip or held-out accuracy, on small rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import (
    decontamination,
    line_dedup,
    ngram_join,
    pii,
    quality_rules,
    sentencepiece_codec,
    span_dedup,
    substring_dedup,
    toxicity,
    url_filters,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, did string, line string, component int"
ODD = [None, "", " ", "\n\n", "one", "é😀 日本", "a" * 3000, "ab " * 4000, "x.\ny!\nz?"]


def prose(rng: random.Random, words: int) -> str:
    made = ["".join(rng.choice(["the", "on", "re", "ti", "sh", "an", "or"]) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    return ". ".join(" ".join(made[i : i + 7]) for i in range(0, words, 7)) + "."


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(30, 150)) for _ in range(30)]
    texts += [texts[i] for i in (0, 1, 1)]
    texts += [t.replace(" the", " THE", 1) + " end" for t in texts[:6]]
    texts += [texts[7][:200] + "\n" + texts[8], texts[9] + "\n" + texts[10]]
    return list(enumerate(texts + ODD))


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(i, t, "en", "src0", len(t or ""), "did", "line", 1) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def test_substrings_match_brute_force(docs, rows, empty):
    seen, want = set(), {}
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            window = data[s : s + 100]
            if window in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        want[i] = (len(data), sum(gone), spans, sha(kept))
    got = substring_dedup.remove_repeats(docs).drop("kept").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == want
    assert sum(w[1] for w in want.values()) > 3000
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_blocks_hold_every_window_once():
    data = ("abcab" * 100).encode() + bytes(random.Random(1).randrange(97, 100) for _ in range(900))
    texts = substring_dedup.bytes_of(pa.array([data.decode(), "short"]))
    values = substring_dedup.Hasher().values
    keys, text, start, count, anchor = substring_dedup.blocks_of(values, *texts)
    windows = sorted(s + k for s, n in zip(start.tolist(), count.tolist(), strict=True) for k in range(n))
    assert windows == list(range(len(data) - 99)) and not text.any() and (anchor < substring_dedup.SPAN).all()


def test_sentence_spans(spark):
    run = "One two three. Four five six. Seven eight nine."
    rows = [(1, f"Start here. {run} End."), (2, f"{run}\nOther words follow."), (3, "One two three. Four five six."), (4, None), (None, run)]
    got = {r["doc_id"]: r for r in span_dedup.remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_removed"] == 0 and got[3]["n_removed"] == 0 and got[4]["kept"] == ""
    assert (got[2]["n_removed"], got[2]["kept"]) == (3, "Other words follow.")
    assert (got[None]["n_removed"], got[None]["kept_sha256"]) == (3, sha(""))


def test_passages_between_other_text_lose_their_whole_sentences(spark):
    rng = random.Random(17)
    whole = [" ".join(prose(rng, 14).replace(".", "").split()) + "." for _ in range(2)]
    passage = f"tail of one sentence. {whole[0]} {whole[1]} head of another"
    rows = [(1, f"First words before the {passage} that ends so."), (2, f"Second text with some {passage} and goes on. Its own end.")]
    got = {r["doc_id"]: r for r in span_dedup.remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] == 2
    assert got[2]["kept"] == "Second text with some tail of one sentence. head of another and goes on. Its own end."


def shingle_set(text: str | None) -> frozenset:
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_jaccard_classes_match_brute_force(docs, rows, empty):
    sets = {i: shingle_set(t) for i, t in rows}
    multi = {i: tuple(sorted(Counter(tuple((t or "").lower().split()[k : k + 5]) for k in range(len((t or "").split()))).items())) for i, t in rows}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = {i: set() for i in sets}
    for i in sets:
        for j in sets:
            if j < i and (multi[i] == multi[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
                if multi[i] != multi[j]:
                    links[i].add(multi[j])
                    links[j].add(multi[i])
    got = {r["doc_id"]: r for r in ngram_join.jaccard_classes(docs).collect()}
    assert {i: (r["class_id"], r["n_links"]) for i, r in got.items()} == {i: (top(i), len(links[i])) for i in sets}
    assert ngram_join.jaccard_classes(empty).count() == 0
    kept = ngram_join.first_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len({top(i) for i in sets})


def test_forest_depth():
    assert 1 - (1 - 0.8 ** ngram_join.depth_for()) ** ngram_join.TREES >= ngram_join.RECALL
    assert ngram_join.depth_for(0.99) == ngram_join.DEEPEST


def test_lines_match_brute_force(spark, empty):
    rng = random.Random(5)
    base = prose(rng, 400).replace("\n", " ")
    rows = [(1, f"{base}\nshort line\n\n{base}"), (2, "Short LINE \nanother"), (3, base.replace(" ", "  ", 1)), (4, None), (5, "\n \n")]
    rows += [(6, f"{base} {base.split()[3]}"), (7, "quite another line of words")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, h1 string")
    got = {r["doc_id"]: r["removed"] for r in line_dedup.line_report(docs).collect()}
    assert got == {1: "3", 2: "0", 3: "0", 4: "", 5: "", 6: "0", 7: ""}
    kept = {r["doc_id"]: r["text"] for r in line_dedup.without_repeated_lines(docs).collect()}
    assert kept == {1: f"{base}\nshort line\n", 2: "another", 4: None, 5: "\n \n", 7: rows[-1][1]}
    assert line_dedup.line_report(empty).count() == 0


def test_lines_with_changed_words_meet(spark):
    rng = random.Random(21)
    rows, pairs = [], []
    for k in range(60):
        words = prose(rng, rng.choice([6, 10, 20, 50])).split()
        other = list(words)
        room = 0.15 * len(" ".join(words))
        for i in rng.sample(range(len(words)), len(words)):
            if len(words[i]) <= room:
                room -= len(words[i])
                other[i] = "x" * len(words[i])
        if other == words:
            other[-1] = other[-1].rstrip(".") + "!"
        pairs.append((2 * k, 2 * k + 1))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    rows += [(1000, "..."), (1001, "... !!"), (1002, "quite other words in this line")]
    got = {r["doc_id"]: r["removed"] for r in line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[b] == "0" for _, b in pairs) >= 57 and not any(got[a] for a, _ in pairs) and got[1002] == ""


def test_block_pairs_meet_within_bits(spark):
    rng = random.Random(9)
    values = []
    for i in range(40):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), line_dedup.BITS):
            b ^= 1 << bit
        values += [(2 * i, a), (2 * i + 1, b)]
    signed = [(k, v - 2**64 if v >= 2**63 else v) for k, v in values]
    pairs = line_dedup.near_pairs(spark.createDataFrame([(*r, r[0]) for r in signed], "h1 long, simhash long, group long")).collect()
    assert {(2 * i, 2 * i + 1) for i in range(40)} <= {(p["u"], p["v"]) for p in pairs}


def test_quality_measures(docs, rows, empty):
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        many = Counter(runs)
        repeat = {k + d for k, run in enumerate(runs) if many[run] > 1 for d in range(5)}
        failed = len(words) < 10 or 100 * len(repeat) > 20 * len(words)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["base_failed"]) == (len(words), sum(map(len, words)), len(repeat), failed)
    assert quality_rules.judge(empty).count() == 0 and quality_rules.keep_good(docs).columns == docs.columns


def test_texts_of_a_rare_language_are_judged_by_their_own(spark):
    rng = random.Random(41)

    def made(words: list[str], n: int) -> str:
        return " ".join(rng.choice(words[:12] if rng.random() < 0.6 else words) for _ in range(n)) + "."

    common = ["".join(rng.choice("aeioustrn") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    other = ["".join(rng.choice("aoukzwybv") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows = [(i, made(common, 800), "en") for i in range(400)] + [(1000 + i, made(other, 300), "xx") for i in range(4)]
    docs = spark.createDataFrame([*rows, (2000, made(other, 300), None), (2001, made(other, 800), "en")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs).collect()}
    assert all(got[i] for i, _, _ in rows) and got[2000] and not got[2001]


def test_sentencepiece_agrees_with_the_library(spark, empty):
    sentencepiece = pytest.importorskip("sentencepiece")
    processor = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.model_file())
    texts = [*ODD, "  a  b ", "▁x ▁", "<s> <0x41>", "tab\tx\r\n", "a▁▁", "\x00 z", " ﬁ"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in sentencepiece_codec.encoded(docs).collect()}
    for i, text in enumerate(texts):
        ids = processor.encode(text or "")
        assert (got[i]["ids"], got[i]["decoded"]) == (ids, processor.decode(ids))
    digest = {r["doc_id"]: r["ids_sha256"] for r in sentencepiece_codec.digests(docs).collect()}
    assert digest[4] == sha(",".join(map(str, processor.encode("one"))))
    assert sentencepiece_codec.digests(empty).count() == 0


def test_urls(spark):
    urls = ["http://A.Example.com/en/1", "https://www.example.com/en/2", "http://x.net/fr/3", "http://x.net?/fr/", "ftp//x", None, "http://notcom/x", "http://b.org/y"] * 3
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = [tuple(r)[1:5] for r in url_filters.judge(pages).orderBy("page_id").collect()]
    assert got[:3] == [
        ("a.example.com", "/en/1", "example.com/en/", "block"),
        ("www.example.com", "/en/2", "www.example.com/en/", "allow"),
        ("x.net", "/fr/3", "net/fr/", "block"),
    ]
    assert [g[:3] for g in got[3:8]] == [("x.net", "", None), ("", "", None), ("", "", None), ("notcom", "/x", None), ("b.org", "/y", None)]
    assert url_filters.judge(pages.where("false")).count() == 0


def test_edit_distance_and_leaks(spark, empty):
    assert decontamination.edits_within("kitten", "a sitting cat") == (2, 8)
    rng = random.Random(2)
    items = [prose(rng, 30) for _ in range(3)]
    words = items[1].split()
    words[12] = "changed"
    rows = [(1, f"before {items[0]} after"), (2, " ".join(words)), (3, prose(rng, 200)), (4, None), (5, ""), (6, items[0].upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.leaks(docs, bench).collect()}
    assert set(got) == {(1, 0), (2, 1), (6, 0)} and got[1, 0]["first_word"] == 1 and got[1, 0]["similarity"] == 1
    assert {r["doc_id"] for r in decontamination.without_leaks(docs, bench).collect()} == {3, 4, 5}
    assert decontamination.leaks(empty, bench).count() == 0 and decontamination.leaks(docs, bench.where("false")).count() == 0


def test_leaks_down_to_the_reported_similarity():
    rng = random.Random(31)
    texts = [prose(rng, 40) for _ in range(60)]
    items = decontamination.Items(list(enumerate(texts)))
    found = near = 0
    for i, text in enumerate(texts):
        chars = list(text)
        for at in rng.sample(range(len(chars)), int(0.15 * len(chars))):
            chars[at] = rng.choice("bcdfgjkm")
        changed = f"{prose(rng, 30)} {''.join(chars)} {prose(rng, 30)}"
        distance, end = decontamination.edits_within(text, changed)
        _, back = decontamination.edits_within(text[::-1], changed[:end][::-1])
        if 1 - distance / max(len(text), back) < decontamination.SIMILARITY:
            continue
        near += 1
        got = decontamination.matches(items, pa.array([changed]), decontamination.Hasher())
        found += i in {g[1] for g in got}
    assert near > 40 and found >= 0.9 * near


def test_every_leak_down_to_the_similarity_is_found():
    """Single characters changed all over items of any length, two places in a text, against brute force."""
    rng = random.Random(41)
    texts = [prose(rng, n)[:m] for n, m in ((1, 3), (2, 5), (3, 9), (4, 14), (5, 21), (8, 35), (10, 63), (10, 64), (12, 65))]
    texts += [prose(rng, rng.randint(12, 50)) for _ in range(25)]
    items = decontamination.Items(list(enumerate(texts)))

    def edited(text: str, share: float) -> str:
        chars = list(text)
        for _ in range(int(share * len(text))):
            at = rng.randrange(len(chars))
            chars[at : at + rng.choice([0, 1, 1])] = rng.choice(["", "q", "x", "yz"][: 4 if len(chars) > 3 else 2])
        return "".join(chars)

    def similar(item: str, text: str) -> bool:
        distance, end = decontamination.edits_within(item, text)
        _, back = decontamination.edits_within(item[::-1], text[:end][::-1])
        return 1 - distance / max(len(item), back) >= decontamination.SIMILARITY

    docs = [f"{prose(rng, 20)} {edited(t, share)} {prose(rng, 20)}" for t in texts for share in (0.1, 0.15, 0.18, 0.2)]
    docs += [None, "", f"{texts[-1]} {prose(rng, 60)} {texts[-1]}"]
    got = decontamination.matches(items, pa.array(docs), decontamination.Hasher())
    norm = [" ".join((t or "").lower().split()) for t in docs]
    want = {(d, i) for d, text in enumerate(norm) for i, item in enumerate(items.texts) if text and similar(item, text)}
    assert {(g[0], g[1]) for g in got} == want and len({w for w in want if w[1] >= 9}) > 60
    assert len([g for g in got if g[:2] == (len(docs) - 1, len(texts) - 1)]) == 2
    assert not decontamination.matches(items, pa.array([None, "", "zz"]), decontamination.Hasher())


def test_a_place_is_not_cut_where_it_is_looked_for_first():
    rng = random.Random(44)
    item = prose(rng, 40)
    text = f"{prose(rng, 30)} {item} {prose(rng, 30)}"
    begin = text.index(item)
    for shift in (-40, -3, 0, 5, 40):
        near = (begin + shift, begin + shift + len(item))
        assert [p for p in decontamination.pieces(item, text, near) if p[2] > 0.9] == [(begin, begin + len(item), 1.0)]


def test_only_different_runs_of_an_item_make_a_region(monkeypatch):
    """A few runs that stand again and again need no edit distance; tables of runs and sorted runs find the same."""
    rng = random.Random(43)
    texts = [f"{prose(rng, 30)} {end}" for end in ("\U0001f600 \u4e2d\u6587", "again and again", "more")]
    docs = pa.array([prose(rng, 25) + " " + t.replace("e", "x", 3) for t in texts] + ["\U0001f600" * 9, "\u4e2d \U0001f600 a"])
    for rows in (texts, texts[1:]):
        found = []
        for table in (1 << 23, 1):
            monkeypatch.setattr(decontamination, "RUN_TABLE", table, raising=False)
            got = decontamination.matches(decontamination.Items(list(enumerate(rows))), docs, decontamination.Hasher())
            found.append(sorted(got))
        assert found[0] == found[1] and {g[:2] for g in found[0]} == {(i + 3 - len(rows), i) for i in range(len(rows))}
    items = decontamination.Items([(1, f"{prose(rng, 30)} the the the")])
    compared = []
    least = decontamination.Items.least
    monkeypatch.setattr(decontamination.Items, "least", lambda *a: compared.append(1) or least(*a))
    assert not decontamination.matches(items, pa.array(["the " * 500]), decontamination.Hasher()) and not compared
    assert decontamination.matches(items, pa.array(items.texts), decontamination.Hasher()) and compared


def test_words_are_kept_once_and_decode_in_batches(monkeypatch):
    """Texts of all kinds against the library, with a table that is emptied again and again."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.model_file())
    texts = ["  a  b ▁c ", "▁", "▁▁x", " lead", "trail ", "a　b", "ﬁ ① x", "\n \n", "日本 é", "plain words here", "a\tb", "é é"] * 3
    for limit in (3, 10**6):
        monkeypatch.setattr(sentencepiece_codec, "MAX_WORDS", limit)
        table = sentencepiece_codec.WordTable(sentencepiece_codec.model_file())
        got = [pair for text in texts for pair in table.encode([text])]
        ids = [processor.encode(text) for text in texts]
        assert got == [(",".join(map(str, i)), processor.decode(i)) for i in ids]
    assert "plain" in table.ids and "plain" not in table.changed


def luhn_ok(digits: str) -> bool:
    total = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
    return 12 <= len(digits) <= 19 and total % 10 == 0


def test_base_spans_match_the_patterns(spark, empty):
    texts = ["a@b.c@d.e %x@y.z", "x@y.z-%q@r.s", "1.2.3.4.5.6 256.1.1.1 0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "é😀 a@b.co 日 +49 30 1234567.", "1 " * 300, "+1 (22) 333-4444 5", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.report(docs).collect()}
    checks = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: luhn_ok(re.sub("[^0-9]", "", s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    )
    for i, text in enumerate(texts):
        spans = sorted((m.start(), n, k, m.end()) for n, (k, p, good) in enumerate(checks) for m in re.finditer(p, text or "") if good(m.group()))
        assert got[i]["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans))
    assert {r["doc_id"]: r["text"] for r in pii.redacted(docs).collect()}[5] == "é😀 [EMAIL] 日 [PHONE]."
    assert pii.report(empty).count() == 0


def test_all_proposals_teach(spark, monkeypatch):
    texts = [f"call +49 30 {1000000 + 7919 * i} or room {i % 90 + 10} token=ab{i}cd9xyzq7 end" for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(pii, "MAX_SAMPLE", 10, raising=False)
    rows = pii.with_candidates(docs)
    known = pii.counted(rows)
    assert known.agg(F.sum("weight")).first()[0] == rows.select(F.explode("proposals")).count() > 1000
    assert known.count() < 400 and pii.fitted(rows) is not None


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(360):
        words = prose(rng, 40).split()
        toxic = i % 3 == 0
        for _ in range(3 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["vilescum", "nastyfool"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, "")]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_texts(docs, known).collect()}
    held = [i for i, _ in labels if got[i]["held_out"]]
    assert held and sum(got[i]["predicted"] == dict(labels)[i] for i in held) >= 0.95 * len(held)
    assert got[1000]["score"] == got[1001]["score"] and 0 <= got[1000]["score"] <= 1
    assert toxicity.score_texts(docs, known.where("false")).agg(F.max("score")).first()[0] == 0


def test_documents_without_ids_are_told_apart(spark):
    rng = random.Random(12)
    one, two, three = (prose(rng, 60) for _ in range(3))
    rows = [(None, one), (None, f"{two}\n{one}"), (None, three), (None, three), (4, two), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = ngram_join.first_of_each(docs).collect()
    assert sorted((r["text"] or "") for r in kept) == sorted(["", one, f"{two}\n{one}", three, two])
    lines = [r["text"] for r in line_dedup.without_repeated_lines(docs).collect()]
    # Line 0 of one document goes without harm to line 0 of the others.
    assert lines.count(three) == 2 and two in lines and sum(one in (t or "") for t in lines) == 1
    spans = [r["kept"] for r in span_dedup.remove_repeated_spans(docs).collect()]
    assert spans.count(three) == 2 and two in spans and sum(one in t for t in spans) == 1
    cut = [r["n_removed"] for r in substring_dedup.remove_repeats(docs).collect() if r["doc_id"] is None]
    assert sum(n > 0 for n in cut) in (1, 2)
