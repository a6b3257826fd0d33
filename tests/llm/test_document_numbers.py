"""One doc_id on several texts, ids of any size, null ids and repeated rows in the operators that number documents."""

from __future__ import annotations

import hashlib

import pytest

from corpusloom.llm import ngram_join, span_dedup, substring_dedup
from corpusloom.llm.tables import numbered_documents

ROW = "doc_id long, text string, did string, tid string, __x int"
LARGE = [2**62 + 5, 2**63 - 1]


def words(seed: int, n: int) -> str:
    return " ".join(hashlib.sha256(f"{seed}-{i}".encode()).hexdigest()[: 3 + i % 5] for i in range(n))


def sentences(seed: int, n: int) -> str:
    return " ".join(words(seed * 100 + i, 9).capitalize() + "." for i in range(n))


def make(spark, rows):
    return spark.createDataFrame([(i, t, "d", "t", 1) for i, t in rows], ROW).repartition(3)


def test_numbers_follow_ids_and_tell_texts_apart(spark):
    rows = [(7, "b"), (7, "a"), (7, "a"), (LARGE[1], "x"), (LARGE[0], "x"), (-3, None), (None, "x"), (None, ""), (None, "")]
    made, names = numbered_documents(make(spark, rows))
    got = {(r["doc_id"], r["text"]): r["__did"] for r in made.collect()}
    assert made.count() == len(rows) and len(set(got.values())) == 7 == names.count()
    assert got[(-3, None)] < min(got[(7, "a")], got[(7, "b")]) and max(got[(7, "a")], got[(7, "b")]) < got[(LARGE[0], "x")]
    assert got[(LARGE[0], "x")] < got[(LARGE[1], "x")] < min(got[(None, "x")], got[(None, "")])
    plain, names = numbered_documents(make(spark, [(5, "a"), (LARGE[0], "b"), (5, "a")]))
    assert names is None and {r["__did"] for r in plain.collect()} == {5, LARGE[0]}


@pytest.mark.parametrize("ids", [(1, 1, 2), (1, 3, LARGE[0]), (LARGE[0], LARGE[1], None), (None, None, None)])
def test_substrings_of_any_ids(spark, ids):
    shared = words(1, 60)
    texts = [words(2, 40) + shared + words(3, 40), "short " + words(4, 5), shared]
    rows = list(zip(ids, texts, strict=True))
    got = sorted((tuple(r) for r in substring_dedup.remove_repeats(make(spark, rows)).drop("kept").collect()), key=str)
    order = sorted(range(3), key=lambda i: (ids[i] is None, ids[i] or 0))
    if len(set(ids)) == 3:
        seen, want = set(), []
        for i in order:
            data, gone = texts[i].encode(), bytearray(len(texts[i]))
            for s in range(len(data) - 99):
                if data[s : s + 100] in seen:
                    gone[s : s + 100] = b"\1" * 100
                seen.add(data[s : s + 100])
            kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
            spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
            want.append((ids[i], len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
        assert got == sorted(want, key=str)
    else:  # which of the texts of one id comes first is the hash's choice: the shared part goes once
        assert sorted(r[0] is None for r in got) == sorted(i is None for i in ids)
        assert sum(r[2] for r in got) == len(shared)


def test_sentence_spans_of_one_id_on_two_texts(spark):
    run = sentences(5, 4)
    rows = [(1, run), (1, "Own words."), (1, "Own words."), (LARGE[1], f"{sentences(6, 1)} {run}"), (None, run)]
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_sentences"], r["n_removed"]) for r in span_dedup.remove_repeated_spans(make(spark, rows)).collect())
    assert got == [(False, 1, 1, 0), (False, 1, 1, 0), (False, 1, 4, 0), (False, LARGE[1], 5, 4), (True, None, 4, 4)]


def test_classes_of_one_id_on_two_texts(spark):
    a, b, c = words(7, 80), words(8, 80), words(9, 80)
    rows = [(1, a), (1, b), (2, a + " end"), (LARGE[0], b + " end"), (LARGE[1], c), (None, c + " end"), (None, "alone")]
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.jaccard_classes(make(spark, rows)).collect()), key=str)
    want = [(1, 1, 1), (1, 1, 1), (2, 1, 1), (LARGE[0], 1, 1), (LARGE[1], LARGE[1], 1), (None, LARGE[1], 1), (None, None, 0)]
    assert got == sorted(want, key=str)
    kept = ngram_join.first_of_each(make(spark, rows))
    assert sorted((r["text"] for r in kept.collect())) == sorted([a, b, c, "alone"]) and kept.columns == ["doc_id", "text", "did", "tid", "__x"]


def test_two_texts_of_one_id_stay_apart(spark):
    a, b = words(10, 80), words(11, 80)
    rows = [(1, a), (1, b), (5, a + " x"), (6, b + " x"), (6, a + " y")]
    kept = ngram_join.first_of_each(make(spark, rows)).collect()
    assert sorted(r["text"] for r in kept) == sorted([a, b])
