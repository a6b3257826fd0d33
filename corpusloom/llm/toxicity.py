"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as a hashed word vector and the mean of its hashed vectors of 3 and 6 bytes of its characters. Windows of
`WINDOW` words, overlapping by a quarter, the last one at the end, cover each whole text; a text's score is that of
its highest window, and training follows the highest window of each sampled text. Only texts and labels are
used: doc_id decides who may teach (crc32 of its decimal text, modulo 3, is not 1) but is no input.

The network is fitted on the driver on at most `MAX_SAMPLE` labelled texts of each class, the ones least by a
hash of the id, and at most `SAMPLE_CHARS` characters of each (texts that are longer teach nothing); that is the
only bound, and scoring reads everything. Null and empty texts have one empty window, whose score is the
network's bias. Repeated rows are scored alike. Without two classes to learn from, every score is the share of
toxic labels, or 0 without labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import Hasher, mixed, slices, texts_of

WINDOW, STEP = 32, 24
WIDTH, HIDDEN = 8, 8
WORD_ROWS, GRAM_ROWS = 1 << 14, 1 << 15
MAX_SAMPLE, SAMPLE_CHARS = 1200, 6000
EPOCHS, BATCH, RATE, DECAY, DROP = 8, 128, 0.01, 0.1, 0.3
KNOWN_SHARE, KNOWN_TEXTS = 0.02, 5
THRESHOLD = 0.7


def word_bytes() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in ((48, 58), (65, 91), (97, 123), (128, 256)):
        table[low:high] = True
    return table


class Tokens:
    """Distinct words of some texts as features, and every window as numbers of distinct words (0 pads)."""

    def __init__(self, column: pa.Array, hasher: Hasher) -> None:
        texts = texts_of(pc.utf8_lower(column.fill_null("") if column.null_count else column))
        starts, ends, owner = texts.words(word_bytes())
        hashes = hasher.spans(hasher.prefix(texts.data), starts, ends)
        distinct, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        self.rows = np.append(0, (1 + distinct % np.uint64(WORD_ROWS - 1)).astype(np.int64))
        begin, end = starts[first], ends[first]
        length = end - begin
        self.word = np.repeat(np.arange(1, len(distinct) + 1), length)
        at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length - begin, length)
        left = np.where(at == np.repeat(begin, length), 32, texts.data[at - 1]).astype(np.int64)
        right = np.where(at + 1 == np.repeat(end, length), 32, texts.data[at + 1]).astype(np.int64)
        three = left * 65536 + texts.data[at].astype(np.int64) * 256 + right
        # Six bytes as two threes; near the end of a word the second is that of its last byte.
        then = three[np.minimum(np.arange(len(at)) + 3, np.repeat(np.cumsum(length), length) - 1)]
        six = mixed((three * 16777259 + then).astype(np.uint64))
        grams = np.concatenate((mixed(three.astype(np.uint64)), six + np.uint64(1)))
        self.grams = (grams % np.uint64(GRAM_ROWS)).astype(np.int64)
        self.word = np.concatenate((self.word, self.word))
        self.share = np.append(0.0, 1.0 / np.maximum(1, length)).astype(np.float32)
        count = np.bincount(owner, minlength=len(texts))
        windows = np.maximum(1, 1 + -(-np.maximum(0, count - WINDOW) // STEP))
        self.text = np.repeat(np.arange(len(texts)), windows)
        part = np.arange(len(self.text)) - np.repeat(np.cumsum(windows) - windows, windows)
        offset = np.minimum(part * STEP, np.maximum(0, count - WINDOW)[self.text])
        at = offset[:, None] + np.arange(WINDOW)
        real = at < count[self.text][:, None]
        base = (np.cumsum(count) - count)[self.text][:, None]
        ids = np.append(number + 1, 0)
        self.windows = np.where(real, ids[np.minimum(base + at, len(ids) - 1)], 0).astype(np.int32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


class Network:
    """The parameters; `forward` scores windows and `step` fits them by backpropagation through time."""

    def __init__(self, seed: int = 7) -> None:
        self.rng = rng = np.random.default_rng(seed)

        def init(*shape: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        h = HIDDEN
        self.p = {
            "word": np.zeros((WORD_ROWS, WIDTH), dtype=np.float32),
            "gram": np.zeros((GRAM_ROWS, WIDTH), dtype=np.float32),
            "input": init(2 * WIDTH, 6 * h, scale=0.4),
            "bias": np.zeros(6 * h, dtype=np.float32),
            "left": init(h, 3 * h, scale=0.3),
            "right": init(h, 3 * h, scale=0.3),
            "look": init(2 * h, scale=0.5),
            "out": init(2 * h, scale=0.5),
            "shift": np.full(1, -1.0, dtype=np.float32),
        }
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0
        self.known = {"word": np.ones(WORD_ROWS, dtype=np.float32), "gram": np.ones(GRAM_ROWS, dtype=np.float32)}

    def features(self, tokens: Tokens) -> np.ndarray:
        chars = np.zeros((len(tokens.rows), WIDTH), dtype=np.float32)
        values = self.p["gram"][tokens.grams]
        for i in range(WIDTH):
            chars[:, i] = np.bincount(tokens.word, weights=values[:, i], minlength=len(tokens.rows))
        return np.concatenate((self.p["word"][tokens.rows], chars * tokens.share[:, None]), axis=1)

    def _pass(self, gates: np.ndarray, real: np.ndarray, weights: np.ndarray, order: range, keep: list | None):
        h = HIDDEN
        state = np.zeros((real.shape[1], h), dtype=np.float32)
        out = np.empty((WINDOW, len(state), h), dtype=np.float32)
        whole = real.all(axis=1)
        for t in order:
            x, u = gates[t], state @ weights
            zr = sigmoid(x[:, : 2 * h] + u[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(x[:, 2 * h :] + r * u[:, 2 * h :])
            if keep is not None:
                keep.append((t, state, z, r, n, u[:, 2 * h :]))
            change = n - state
            change *= 1 - z
            if not whole[t]:
                change *= real[t][:, None]
            state = state + change
            out[t] = state
        return out

    def forward(self, table: np.ndarray, windows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        h = HIDDEN
        windows = np.ascontiguousarray(windows.T)
        real = (windows > 0).astype(np.float32)
        kept = ([], []) if keep is not None else (None, None)
        left, right = np.ascontiguousarray(table[:, : 3 * h]), np.ascontiguousarray(table[:, 3 * h :])
        states = np.concatenate(
            (
                self._pass(left[windows], real, self.p["left"], range(WINDOW), kept[0]),
                self._pass(right[windows], real, self.p["right"], range(WINDOW - 1, -1, -1), kept[1]),
            ),
            axis=2,
        )
        look = states @ self.p["look"] - 30.0 * (1 - real)
        look = np.exp(look - look.max(axis=0))
        weight = look / look.sum(axis=0)
        pooled = (weight[:, :, None] * states).sum(axis=0)
        if keep is not None:
            keep.update(real=real.T, kept=kept, states=states.transpose(1, 0, 2), weight=weight.T, pooled=pooled)
        return pooled @ self.p["out"] + self.p["shift"][0]

    def scores(self, tokens: Tokens, part: int = 512) -> np.ndarray:
        table = self.features(tokens) @ self.p["input"] + self.p["bias"]
        runs = [self.forward(table, tokens.windows[i : i + part]) for i in range(0, len(tokens.windows), part)]
        return np.concatenate(runs)

    def _back(self, kept: list, real: np.ndarray, d_out: np.ndarray, weights: np.ndarray, d_gates: np.ndarray) -> np.ndarray:
        h = HIDDEN
        d_state = np.zeros((len(real), h), dtype=np.float32)
        d_weights = np.zeros_like(weights)
        for t, before, z, r, n, u in reversed(kept):
            on = real[:, t : t + 1]
            d = (d_state + d_out[:, t]) * 1.0
            dz = d * on * (before - n) * z * (1 - z)
            dn = d * on * (1 - z) * (1 - n * n)
            dr = dn * u * r * (1 - r)
            d_gates[:, t] = np.concatenate((dz, dr, dn), axis=1)
            du = np.concatenate((dz, dr, dn * r), axis=1)
            d_weights += before.T @ du
            d_state = d * (1 - on * (1 - z)) + du @ weights.T
        return d_weights

    def step(self, tokens: Tokens, chosen: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        h, keep = HIDDEN, {}
        features = self.features(tokens)
        stay = (self.rng.random(features.shape) >= DROP).astype(np.float32) / (1 - DROP)
        features = features * stay
        windows = tokens.windows[chosen]
        used, local = np.unique(windows, return_inverse=True)
        local = local.reshape(windows.shape)
        table = features[used] @ self.p["input"] + self.p["bias"]
        positions = np.where(windows > 0, local, 0) if used[0] == 0 else local + 1
        if used[0] != 0:
            table = np.concatenate((np.zeros((1, table.shape[1]), dtype=np.float32), table))
        logits = self.forward(table, positions, keep)
        d = ((sigmoid(logits) - labels) * weights / len(labels)).astype(np.float32)
        g = {"shift": np.array([d.sum()]), "out": keep["pooled"].T @ d}
        d_pooled = d[:, None] * self.p["out"]
        d_weight = np.einsum("mh,mth->mt", d_pooled, keep["states"])
        d_look = keep["weight"] * (d_weight - (keep["weight"] * d_weight).sum(axis=1, keepdims=True))
        g["look"] = np.einsum("mt,mth->h", d_look, keep["states"])
        d_states = keep["weight"][:, :, None] * d_pooled[:, None, :] + d_look[:, :, None] * self.p["look"]
        d_gates = np.zeros((*windows.shape, 6 * h), dtype=np.float32)
        g["left"] = self._back(keep["kept"][0], keep["real"], d_states[:, :, :h], self.p["left"], d_gates[:, :, : 3 * h])
        g["right"] = self._back(keep["kept"][1], keep["real"], d_states[:, :, h:], self.p["right"], d_gates[:, :, 3 * h :])
        flat, where = d_gates.reshape(-1, 6 * h), windows.ravel()
        d_table = np.zeros((len(tokens.rows), 6 * h), dtype=np.float32)
        for i in range(6 * h):
            d_table[:, i] = np.bincount(where, weights=flat[:, i], minlength=len(tokens.rows))
        d_table[0] = 0
        g["bias"] = d_table.sum(axis=0)
        g["input"] = features.T @ d_table
        d_features = (d_table @ self.p["input"].T) * stay
        g["word"] = np.zeros_like(self.p["word"])
        np.add.at(g["word"], tokens.rows, d_features[:, :WIDTH])
        shared = (d_features[:, WIDTH:] * tokens.share[:, None])[tokens.word]
        g["gram"] = np.stack(
            [np.bincount(tokens.grams, weights=shared[:, i], minlength=GRAM_ROWS) for i in range(WIDTH)], axis=1
        )
        # What few sampled texts hold would only tell those texts apart: its vector stays zero.
        for k, known in self.known.items():
            g[k] *= known[:, None]
        self._adam(g)

    def _adam(self, g: dict) -> None:
        self.t += 1
        for k, grad in g.items():
            grad = np.clip(grad, -1, 1).astype(np.float32)
            self.m[k] = 0.9 * self.m[k] + 0.1 * grad
            self.v[k] = 0.99 * self.v[k] + 0.01 * grad * grad
            rate = RATE * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
            self.p[k] -= (rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-5) + RATE * DECAY * self.p[k]).astype(np.float32)


def fit(texts: list[str], labels: np.ndarray, seed: int = 7) -> Network:
    """Fit on texts labelled 0 or 1: each round trains on the highest window of every text."""
    network, rng, hasher = Network(seed), np.random.default_rng(seed), Hasher()
    order = rng.permutation(len(texts))
    groups = []
    for at in range(0, len(order), BATCH):
        part = order[at : at + BATCH]
        groups.append((Tokens(pa.array([texts[i] for i in part], pa.string()), hasher), labels[part].astype(np.float32)))
    in_texts = {"word": np.zeros(WORD_ROWS), "gram": np.zeros(GRAM_ROWS)}
    for tokens, _ in groups:
        text, word = np.unique(np.stack((np.repeat(tokens.text, WINDOW), tokens.windows.ravel())), axis=1)
        np.add.at(in_texts["word"], tokens.rows[word], 1)
        order = np.argsort(tokens.word, kind="stable")
        many = np.bincount(tokens.word, minlength=len(tokens.rows))[word]
        first = np.searchsorted(tokens.word[order], word)
        at = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pairs = np.unique(np.repeat(text, many) * GRAM_ROWS + tokens.grams[order[at]])
        np.add.at(in_texts["gram"], pairs % GRAM_ROWS, 1)
    in_texts["word"][0] = 0
    network.known = {k: (n >= max(KNOWN_TEXTS, KNOWN_SHARE * len(texts))).astype(np.float32) for k, n in in_texts.items()}
    positive = max(1.0, float(labels.sum()))
    balance = min(10.0, (len(labels) - positive) / positive)
    for epoch in range(max(EPOCHS, -(-60 // len(groups)))):
        for i in rng.permutation(len(groups)):
            tokens, y = groups[i]
            score = network.scores(tokens) if epoch else rng.random(len(tokens.windows))
            best = np.lexsort((-score, tokens.text))
            best = best[np.append(True, tokens.text[best][1:] != tokens.text[best][:-1])]
            network.step(tokens, best, y, np.where(y > 0, balance, 1.0))
    return network


def teachers(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray]:
    """The bounded sample of labelled texts that may be learnt from."""
    may = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    known = labels.where(F.col("toxic").isin(0, 1)).where(may).select("doc_id", "toxic").dropDuplicates(["doc_id"])
    rank = F.xxhash64("doc_id")
    sample = None
    for toxic in (0, 1):
        part = known.where(F.col("toxic") == toxic).orderBy(rank, "doc_id").limit(MAX_SAMPLE)
        sample = part if sample is None else sample.unionByName(part)
    ids = {r["doc_id"]: r["toxic"] for r in sample.collect()}
    if not ids:
        return [], np.zeros(0)
    found = docs.where(F.col("doc_id").isin(list(ids))).where(F.length("text").between(1, SAMPLE_CHARS))
    rows = sorted({(r["doc_id"], r["text"]) for r in found.select("doc_id", "text").collect()})
    return [t for _, t in rows], np.array([ids[i] for i, _ in rows])


def score_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    texts, y = teachers(docs, labels)
    network = fit(texts, y) if 0 < y.sum() < len(y) else None
    flat = float(y.mean()) if len(y) else 0.0
    weights = network.p if network else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        model = Network()
        if weights is not None:
            model.p = weights
        for batch in slices(batches, "text"):
            score = np.full(batch.num_rows, flat)
            if weights is not None:
                tokens = Tokens(batch.column("text"), hasher)
                score = np.full(batch.num_rows, -np.inf)
                np.maximum.at(score, tokens.text, model.scores(tokens))
                score = sigmoid(score)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    scored = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
