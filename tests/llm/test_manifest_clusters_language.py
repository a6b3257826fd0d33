"""Merkle manifest and clustering against brute force, language identification against held-out labels."""

from __future__ import annotations

import hashlib
import math
import random
import string
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import centroids, language_id, merkle

ROW = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["grp", "pos", "digest", "run", "slot", "left", "right", "top", "path", "at", "all", "letter", "pieces", "draw", "v", "h", "cluster"]


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row: tuple, text: str | None) -> str:
    doc_id, _, lang, source, n_chars = row
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def way(levels: list[list[str]], i: int) -> list[tuple[list[str], list[str]]]:
    out = []
    for level in levels[:-1]:
        first = i // 16 * 16
        out.append((level[first:i], level[i + 1 : first + 16]))
        i //= 16
    return out


def manifest(rows: list[tuple]) -> list[tuple]:
    small = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    by: dict = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = [tree([leaf(r, r[1]) for r in by[s]]) for s in sources]
    whole = tree([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            steps = way(trees[k], i) + way(whole, k)
            hit = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            fold = leaf(r, r[1].translate(small) if hit else r[1])
            for left, right in steps:
                fold = h(*left, fold, *right)
            root = whole[-1][0]
            out.append((r[0], trees[k][0][i], trees[k][-1][0], root, h(*(x for a, b in steps for x in a + b)), fold, fold == root))
    return out


def test_manifest_matches_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, f"Text {rng.random()} É😀", "en", "hot", i) for i in range(300)]
    rows += [(300 + i, rng.choice([None, "", "Aa", "x" * 50_000]), rng.choice([None, "de"]), f"s{i % 19}", None) for i in range(60)]
    rows += [(None, "no id", None, None, 1), (None, "no id either", None, None, 1), (7, "null source", "en", None, 3), (9, "A", "", "", 0)]
    rows += [(400, "one id", "en", "hot", 1), (400, "on two texts", "en", "hot", 1), (2**63 - 1, "LARGE", "en", "hot", 1), (-5, "Minus", "en", "É", 1)]
    rows += [rows[3]] * 40  # repeated rows
    rng.shuffle(rows)
    made = spark.createDataFrame(rows, ROW).repartition(5).withColumns({c: F.lit(c) for c in CLASH})
    got = [tuple(r) for r in merkle.manifest(made).collect()]
    assert sorted(map(str, got)) == sorted(map(str, manifest(rows)))
    assert 0 < sum(not r[-1] for r in got) < len(got)


@pytest.mark.parametrize("rows", [[], [(1, "Alone", "en", "a", 5)], [(i, "T", "en", "a", 1) for i in range(17)], [(i, "T", "en", f"s{i}", 1) for i in range(17)]])
def test_manifest_of_few_rows(spark, rows):
    got = [tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, ROW)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, manifest(rows)))


def kmeans(rows: list[tuple], k: int = 40, rounds: int = 5) -> dict:
    good = [(i, e) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    ids = [i for i, _ in good]
    v = [[math.floor(256 * x) for x in e] for _, e in good]
    order = sorted(range(len(v)), key=lambda i: (ids[i] is None, hashlib.sha256(f"2:{ids[i]}".encode()).hexdigest(), v[i]))
    c = [v[i] for i in order[:k]]
    for r in range(rounds + 1):
        d = [[sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for y in c] for x in v]
        at = [x.index(min(x)) for x in d]
        if r < rounds:
            for j in range(len(c)):
                mine = [v[i] for i in range(len(v)) if at[i] == j]
                if mine:
                    c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    total = [sum(d[i][j] for i in range(len(v)) if at[i] == j) for j in range(len(c))]
    return sorted(str((ids[i], at[i], d[i][at[i]], total[at[i]], sum(total), h(",".join(map(str, c[at[i]]))))) for i in range(len(v)))


VECTORS = "vec_id long, embedding array<float>, label int"


def test_clusters_match_brute_force(spark):
    rng = random.Random(9)
    middles = [[rng.uniform(-3, 3) for _ in range(64)] for _ in range(12)]
    rows = [(i, [float(np.float32(x + rng.gauss(0, 0.05))) for x in middles[i % 12]], 0) for i in range(160)]
    rows += [(200 + i, rows[3][1], 1) for i in range(20)] + [rows[5]] * 4  # copies of one vector, repeated rows
    rows += [(None, rows[0][1], 0), (300, None, 0), (301, [], 0), (302, [1.0] * 63, 0), (303, [1.0] * 63 + [None], 0)]
    rows += [(304, [float("nan")] * 64, 0), (305, [1.0] * 63 + [float("-inf")], 0), (306, [0.0] * 64, 0)]
    made = spark.createDataFrame(rows, VECTORS).repartition(4).withColumns({c: F.lit(1) for c in CLASH})
    got = centroids.cluster_vectors(made).collect()
    assert sorted(str(tuple(r)[:6]) for r in got) == kmeans([(i, e) for i, e, _ in rows])
    assert np.mean([r["n_checked"] for r in got]) < 12  # the bounds exclude most of 40 centroids here


def test_clusters_of_few_or_huge_vectors(spark):
    assert centroids.cluster_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    rows = [(i, [float(i % 3)] * 64, 0) for i in range(7)]
    got = centroids.cluster_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted(str(tuple(r)[:6]) for r in got) == kmeans([(i, e) for i, e, _ in rows])
    huge = [(1, [3e38] * 64, 0), (2, [-3e38] * 64, 0)]
    got = centroids.cluster_vectors(spark.createDataFrame(huge, VECTORS)).collect()
    assert {r["distance"] for r in got} == {0} and len({r["cluster"] for r in got}) == 2


def test_bounds_never_exceed_distances():
    rng = np.random.default_rng(4)
    for width in (1, 50, 1 << 26):
        v, c = rng.integers(-width, width, (200, 64)), rng.integers(-width, width, (30, 64))
        c[:5] = v[:5]
        pivots = centroids.pivots_of(c)
        bounds = centroids.lower_bounds(centroids.square_distances(v, pivots), c, pivots)
        real = np.sqrt(centroids.square_distances(v, c).astype(np.float64))
        assert (bounds <= real).all() and bounds.max() > 0


def test_languages_on_held_out_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({c: F.lit(c) for c in CLASH})
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 30 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_languages_of_odd_rows(spark):
    words = {"xx": "baba bobo bubu ", "yy": "tiki toko tuku "}
    rows = [(i, words[lang] * (1 + i % 9), lang, None, 0) for i in range(80) for lang in words]
    rows += [(None, "baba bobo", "yy", None, 0), (1001, None, "xx", None, 0), (1002, "", "xx", None, 0), (1003, "12 !?", "yy", None, 0)]
    rows += [(1004, "tuku toko " * 60_000, None, None, 0), (1004, "baba", None, None, 0), (1005, "é", None, None, 0)]
    rows += [(1006, "bubu baba bobo", None, None, 0)] * 5  # repeated rows
    got = language_id.identify(spark.createDataFrame(rows, ROW).repartition(3)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got if r["doc_id"] is None or r["doc_id"] > 1000}
    assert by[1001] == by[1002] == by[1003] == ("und", 0.0) and by[None][0] == "xx"
    assert {r["lang_pred"] for r in got if r["doc_id"] == 1004} == {"xx", "yy"}
    assert by[1005][0] in words and by[1006][0] == "xx"
    assert len({(r["lang_pred"], r["score"]) for r in got if r["doc_id"] == 1006}) == 1
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_languages_without_teachers(spark):
    none = language_id.identify(spark.createDataFrame([(1, "abc", None, None, 0)], ROW)).collect()
    assert [tuple(r)[2:] for r in none] == [("und", 0.0)]
    one = language_id.identify(spark.createDataFrame([(1, "abc", "xx", None, 0), (3, "def", None, None, 0)], ROW)).collect()
    assert {tuple(r)[2:] for r in one} == {("xx", 1.0)}
    assert language_id.identify(spark.createDataFrame([], ROW)).count() == 0


def test_network_against_plain_loops():
    texts = [b"", b"abc", bytes(range(200)) * 2]
    column = pa.array(texts, pa.binary())
    windows, text, held = language_id.cut(*language_id.bytes_of(column))
    network = language_id.Network(3)
    shares = network.shares(windows)
    row = 0
    for i, data in enumerate(texts):
        for at in range(0, max(1, len(data)), language_id.WINDOW):
            piece = list(data[at : at + language_id.WINDOW])
            assert (text[row], held[row]) == (i, len(piece))
            piece += [language_id.PAD] * (language_id.WINDOW - len(piece))
            best = []
            for w in language_id.WIDTHS:
                said = [sum(network.p["byte"][piece[p + k]] @ network.p[f"filter{w}"][k] for k in range(w)) for p in range(len(piece) - w + 1)]
                best += list(np.max(said, axis=0))
            logits = np.maximum(np.array(best) + network.p["shift"], 0) @ network.p["out"] + network.p["bias"]
            assert np.allclose(shares[row], np.exp(logits) / np.exp(logits).sum(), atol=1e-4)
            row += 1
    assert row == len(windows)


def test_gradients_against_differences(monkeypatch):
    monkeypatch.setattr(language_id, "DROP", 0.0)
    monkeypatch.setattr(language_id, "DECAY", 0.0)
    rng = np.random.default_rng(1)
    windows, labels = rng.integers(0, 256, (6, language_id.WINDOW)).astype(np.int16), np.array([0, 1, 2, 0, 1, 2])
    network = language_id.Network(3)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}

    def loss() -> float:
        return -float(np.log(network.shares(windows)[np.arange(6), labels]).mean())

    before = {k: v.copy() for k, v in network.p.items()}
    network.step(windows, labels)
    found = {k: m / 0.1 for k, m in network.m.items()}
    network.p = before
    for name, grad in found.items():
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        kept = network.p[name][at]
        network.p[name][at] = kept + 1e-5
        up = loss()
        network.p[name][at] = kept - 1e-5
        down = loss()
        network.p[name][at] = kept
        assert math.isclose((up - down) / 2e-5, grad[at], rel_tol=0.02, abs_tol=1e-4), name
