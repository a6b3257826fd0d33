"""Language identification by a byte convolutional network, trained in numpy.

Bytes have trained vectors; filters of several widths slide over windows of `WINDOW` bytes, the largest answer of
each filter within a window is kept, and a softmax over these answers gives the languages' shares of the window.
Windows follow each other through the whole text, the last one padded; a text's shares are those of its windows,
weighted by their bytes, and the largest decides (ties: the language that sorts first).

The network is fitted on the driver, on at most `PER_LANGUAGE` texts of each of the at most `LANGUAGES` most frequent
languages and at most `PIECES` pieces of `WINDOW` characters from each, spread over the whole text; which texts teach
follows from a hash. That sample is the only bound; scoring reads every byte. Only text and a non-null lang of
documents whose crc32(doc_id as text) modulo 4 is not 2 teach; a document without an id does not.

A null text and one without a letter (Unicode category L) get `und` with score 0. Repeated rows are scored alike.
If there is nothing to learn from, every text gets `und` with score 0; with one language all get that one with 1.
Columns other than doc_id, text and lang are not read. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.batches import bytes_of, slices

WINDOW, PAD = 64, 256
WIDTHS, FILTERS, BYTE_WIDTH = (2, 3, 4), 16, 8
LANGUAGES, PER_LANGUAGE, PIECES = 256, 300, 8
EPOCHS, BATCH, RATE, DECAY, DROP, SHORT = 10, 128, 0.01, 1e-4, 0.2, 0.35
PART = 256
UNKNOWN = "und"


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as rows of byte numbers (PAD after the end), the text of each, and how many bytes it holds."""
    length = np.diff(offsets)
    count = np.maximum(1, -(-length // WINDOW))
    text = np.repeat(np.arange(len(length)), count)
    place = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    held = np.minimum(WINDOW, length[text] - place)
    at = (offsets[:-1][text] + place)[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < held[:, None]
    if not len(data):
        return np.full(at.shape, PAD, dtype=np.int16), text, held
    return np.where(inside, data[np.minimum(at, len(data) - 1)].astype(np.int16), np.int16(PAD)), text, held


class Network:
    """Parameters; `forward` gives the logits of windows, `step` fits by back-propagation through the maxima."""

    def __init__(self, languages: int, seed: int = 11) -> None:
        self.rng = rng = np.random.default_rng(seed)

        def init(*shape: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        self.p = {"byte": init(PAD + 1, BYTE_WIDTH, scale=0.5), "shift": np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32)}
        self.p |= {f"filter{w}": init(w, BYTE_WIDTH, FILTERS, scale=(1 / (w * BYTE_WIDTH)) ** 0.5) for w in WIDTHS}
        self.p |= {"out": init(len(WIDTHS) * FILTERS, languages, scale=0.2), "bias": np.zeros(languages, dtype=np.float32)}
        self.p["byte"][PAD] = 0
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0

    def answers(self, windows: np.ndarray, width: int) -> np.ndarray:
        """What each filter of a width says at each place, (place, window, filter): sums of one table row a byte."""
        tables = self.p["byte"] @ self.p[f"filter{width}"]
        places = WINDOW - width + 1
        columns = np.ascontiguousarray(windows.T)
        out = np.take(tables[0], columns[:places], axis=0)
        for k in range(1, width):
            out += np.take(tables[k], columns[k : k + places], axis=0)
        return out

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        best = [self.answers(windows, w).max(axis=0) for w in WIDTHS]
        return np.maximum(np.concatenate(best, axis=1) + self.p["shift"], 0)

    def shares(self, windows: np.ndarray) -> np.ndarray:
        """The softmax of every window, in parts of bounded size."""
        parts = [windows[i : i + PART] for i in range(0, len(windows), PART)]
        return softmax(np.concatenate([self.pooled(x) for x in parts]) @ self.p["out"] + self.p["bias"])

    def step(self, windows: np.ndarray, labels: np.ndarray) -> None:
        rows = np.arange(len(windows))
        places, best = [], []
        for w in WIDTHS:
            said = self.answers(windows, w)
            places.append(said.argmax(axis=0))
            best.append(said.max(axis=0))
        raw = np.concatenate(best, axis=1) + self.p["shift"]
        stay = (self.rng.random(raw.shape) >= DROP).astype(np.float32) / (1 - DROP)
        pooled = np.maximum(raw, 0) * stay
        d = softmax(pooled @ self.p["out"] + self.p["bias"])
        d[rows, labels] -= 1
        d /= len(windows)
        g = {"out": pooled.T @ d, "bias": d.sum(axis=0), "byte": np.zeros_like(self.p["byte"])}
        d_raw = (d @ self.p["out"].T) * stay * (raw > 0)
        g["shift"] = d_raw.sum(axis=0)
        for i, w in enumerate(WIDTHS):
            name, part = f"filter{w}", d_raw[:, i * FILTERS : (i + 1) * FILTERS]
            g[name] = np.zeros_like(self.p[name])
            for k in range(w):
                met = windows[rows[:, None], places[i] + k]
                g[name][k] = np.einsum("nf,nfe->ef", part, self.p["byte"][met])
                np.add.at(g["byte"], met, part[:, :, None] * self.p[name][k].T)
        g["byte"][PAD] = 0
        self.t += 1
        for k, grad in g.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * grad
            self.v[k] = 0.999 * self.v[k] + 0.001 * grad * grad
            rate = RATE * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
            self.p[k] -= (rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-7) + RATE * DECAY * self.p[k]).astype(np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def fit(pieces: list[bytes], labels: np.ndarray, languages: int, seed: int = 11) -> Network:
    """Fit on pieces of text; in each round some are cut short, so that short texts are known too."""
    network, rng = Network(languages, seed), np.random.default_rng(seed)
    data = np.frombuffer(b"".join(p[:WINDOW] for p in pieces), dtype=np.uint8)
    lengths = np.array([min(WINDOW, len(p)) for p in pieces])
    windows, _, _ = cut(data, np.append(0, np.cumsum(lengths)))
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            batch = windows[chosen].copy()
            ends = np.where(rng.random(len(chosen)) < SHORT, rng.integers(4, WINDOW, len(chosen)), WINDOW)
            batch[np.arange(WINDOW) >= ends[:, None]] = PAD
            network.step(batch, labels[chosen])
    return network


def crc_of_id() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def has_letter() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def teachers(docs: DataFrame) -> tuple[list[str], list[bytes], np.ndarray]:
    """The languages, and a bounded sample of pieces with the numbers of their languages."""
    known = docs.where((crc_of_id() % 4 != 2) & F.col("lang").isNotNull() & has_letter())
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return [], [], np.zeros(0, dtype=np.int64)
    languages = sorted((r["lang"] for r in counts), key=lambda x: x.encode())
    # A hash below a language's limit lets about twice as many texts through as are needed, however many there are.
    limits = [x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, (2.0 * PER_LANGUAGE + 50) / r["count"]) * 2.0**31))]
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 31))
    length = F.length("text")
    pieces = F.least(F.lit(PIECES), F.ceil(length / WINDOW))
    spread = F.transform(F.sequence(F.lit(0), pieces.cast("int") - 1), lambda i: F.substring(F.col("text"), 1 + F.floor(i * length / pieces).cast("int"), F.lit(WINDOW)))
    drawn = known.select("lang", "text", draw.alias("draw")).where(F.col("draw") < F.create_map(*limits)[F.col("lang")])
    # Repeated rows have one hash and teach once, so copies of any number stay one row a task.
    once = drawn.select("lang", "draw", spread.alias("pieces")).groupBy("lang", "draw").agg(F.min("pieces").alias("pieces"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw")))
    rows = sorted(ranked.where(F.col("rank") <= PER_LANGUAGE).select("lang", "draw", "pieces").collect())
    number = {name: i for i, name in enumerate(languages)}
    made = [(p.encode(), number[r["lang"]]) for r in rows for p in r["pieces"]]
    return languages, [p for p, _ in made], np.array([y for _, y in made], dtype=np.int64)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    languages, pieces, labels = teachers(docs)
    weights = fit(pieces, labels, len(languages)).p if len(languages) > 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(len(languages))
        if weights is not None:
            network.p = weights
        for batch in slices(batches, "text"):
            best, score = np.zeros(batch.num_rows, dtype=np.int64), np.ones(batch.num_rows)
            if weights is not None:
                windows, text, held = cut(*bytes_of(batch.column("text")))
                shares = network.shares(windows)
                heavy = np.maximum(held, 1)
                total = np.bincount(text, weights=heavy, minlength=batch.num_rows)
                mean = np.stack([np.bincount(text, weights=heavy * s, minlength=batch.num_rows) / total for s in shares.T], axis=1)
                best, score = mean.argmax(axis=1), np.clip(mean.max(axis=1), 0, 1)
            known = batch.column("letter").to_numpy(zero_copy_only=False).astype(bool) & bool(languages)
            names = [languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score"])

    held_out = F.coalesce(crc_of_id() % 4 == 2, F.lit(False))
    rows = docs.select("doc_id", held_out.alias("held_out"), has_letter().alias("letter"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
