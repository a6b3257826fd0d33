"""Quality rules: base counts, and the divergence of a text from its language's reference distributions.

Two histograms describe a text: its characters by class, and its words by the language's common words. The
references are the same histograms summed over every text of that language in the corpus. A text is rejected
if the Jensen-Shannon distance (base 2) to the nearest allowed reference exceeds a limit; short texts get a
larger limit because their histograms are noisy, and below `MIN_WORDS` words only the base rules count.

A common word has at least `COMMON_SHARE` of its language's words, so a language has at most 1 / COMMON_SHARE
of them, and occurs `COMMON_COUNT` times or more, so that a language of few words is not judged by chance words.
Every language gets a reference: what the driver holds is bounded by the number of languages. A text whose
language is null is compared with all references and takes the nearest. Null and empty texts have no words and fail the base rule. Repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import Hasher, Texts, runs_of, slices, texts_of
from corpusloom.llm.tables import stored

COMMON_SHARE = 0.002
COMMON_COUNT = 5
MIN_WORDS = 20
CLASS_LIMIT, CLASS_NOISE = 0.25, 0.5
WORD_LIMIT, WORD_NOISE = 0.13, 2.5
CLASSES = 9


def class_table() -> np.ndarray:
    """Class of each byte; 255 for the later bytes of a character, which count with its first."""
    table = np.full(256, 7, dtype=np.uint8)
    table[[9, 11, 12, 13, 32]] = 0
    table[10] = 1
    table[[ord(c) for c in ".,;:?!'\"()-"]] = 2
    table[ord("0") : ord("9") + 1] = 3
    table[ord("a") : ord("z") + 1] = 4
    table[ord("A") : ord("Z") + 1] = 5
    table[[ord(c) for c in "#*$%&|<>"]] = 6
    table[0xC0:] = 8
    table[0x80:0xC0] = 255
    return table


def repeated_in_text(values: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (text, value) pairs: whether the pair occurs twice or more, and whether it occurred before."""
    order = np.lexsort((values, text))
    v, t = values[order], text[order]
    same = (v[1:] == v[:-1]) & (t[1:] == t[:-1])
    twice, before = np.zeros(len(v), dtype=bool), np.zeros(len(v), dtype=bool)
    twice[order] = np.append(same, False) | np.append(False, same) if len(v) else False
    before[order] = np.append(False, same) if len(v) else False  # lexsort is stable: the first one is the earliest
    return twice, before


def per_text(texts: Texts, owner: np.ndarray, flags: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner if flags is None else owner[flags], minlength=len(texts)).astype(np.int64)


def word_hashes(texts: Texts, hasher: Hasher):
    starts, ends, owner = texts.words()
    sums = hasher.prefix(texts.data)
    return starts, ends, owner, sums, hasher.spans(sums, starts, ends)


def class_counts(texts: Texts) -> np.ndarray:
    classes = class_table()[texts.data]
    classes[texts.offsets[1:] - 1] = 255  # the newline put between texts
    row = np.repeat(np.arange(len(texts)), np.diff(texts.offsets))
    real = classes != 255
    flat = np.bincount(row[real] * CLASSES + classes[real], minlength=len(texts) * CLASSES)
    return flat.reshape(len(texts), CLASSES).astype(np.float64)


def _reference_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, key, n): kind 0 counts character classes, kind 1 words by hash."""
    hasher = Hasher()
    for batch in slices(batches, "text", 1 << 23):
        langs = batch.column("lang").dictionary_encode()
        code = langs.indices.to_numpy(zero_copy_only=False)
        names = langs.dictionary
        words, codes, classes = [], [], np.zeros((len(names), CLASSES))
        at = 0
        for part in slices(iter([batch]), "text"):
            texts = texts_of(part.column("text"))
            own = code[at : at + len(texts)]
            at += len(texts)
            _, _, owner, _, hashes = word_hashes(texts, hasher)
            words.append(hashes)
            codes.append(own[owner])
            np.add.at(classes, own, class_counts(texts))
        words, codes = np.concatenate(words), np.concatenate(codes)
        for c in range(len(names)):
            key, n = np.unique(words[codes == c], return_counts=True)
            keys = np.concatenate((np.arange(CLASSES), key.view(np.int64)))
            kind = np.concatenate((np.zeros(CLASSES, dtype=np.int32), np.ones(len(key), dtype=np.int32)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.DictionaryArray.from_arrays(np.zeros(len(keys), dtype=np.int32), names.slice(c, 1)).cast(pa.string()),
                    pa.array(kind),
                    pa.array(keys),
                    pa.array(np.concatenate((classes[c].astype(np.int64), n))),
                ],
                names=["lang", "kind", "key", "n"],
            )


def references(docs: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per language: class shares, sorted hashes of common words, their shares with the rest last."""
    texts = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.mapInArrow(_reference_rows, "lang string, kind int, key long, n long")
    counts = rows.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    # A counter per word only decides which words are common: the shares come with the language's total.
    spread = F.when(F.col("kind") == 0, F.col("key")).otherwise(F.lit(-1))
    counts = stored(counts)
    totals = counts.groupBy("lang", spread.alias("class")).agg(F.sum("n").alias("n"))
    whole = F.sum(F.when(F.col("class") == -1, F.col("n"))).alias("n")
    large = stored(totals.groupBy("lang").agg(whole).where("n >= 1 and lang <> ''"))
    sizes = {r["lang"]: r["n"] for r in large.collect()}
    least = F.greatest(F.lit(float(COMMON_COUNT)), COMMON_SHARE * F.col("total"))
    kept = counts.join(F.broadcast(large.select("lang", F.col("n").alias("total"))), "lang")
    found: dict[str, list] = {lang: [] for lang in sizes}
    for r in kept.where((F.col("kind") == 0) | (F.col("n") >= least)).collect():
        found[r["lang"]].append(r)
    out = {}
    for lang, total in sizes.items():
        classes = np.zeros(CLASSES)
        for r in found[lang]:
            if r["kind"] == 0:
                classes[r["key"]] = r["n"]
        common = sorted((r["key"] % 2**64, r["n"]) for r in found[lang] if r["kind"] == 1)
        hashes = np.array([k for k, _ in common], dtype=np.uint64)
        shares = np.array([n for _, n in common] + [total - sum(n for _, n in common)], dtype=np.float64)
        out[lang] = (classes / max(1.0, classes.sum()), hashes, shares / total)
    return out


def js_distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row's distribution to the reference."""
    p = counts / np.maximum(1.0, counts.sum(axis=1, keepdims=True))
    q = np.broadcast_to(reference, p.shape)
    m = (p + q) / 2

    def entropy(x: np.ndarray) -> np.ndarray:
        return -(x * np.log2(np.where(x > 0, x, 1.0))).sum(axis=1)

    return np.sqrt(np.maximum(0.0, entropy(m) - (entropy(p) + entropy(q)) / 2))


def distances(texts: Texts, langs: list, owner: np.ndarray, hashes: np.ndarray, refs: dict) -> tuple[np.ndarray, np.ndarray]:
    """Class and word distance of each text to its language's reference, else to the nearest one."""
    n = len(texts)
    best = np.full((2, n), np.inf)
    classes = class_counts(texts)
    langs = np.array([x if x in refs else "" for x in langs], dtype=object)
    for name, (class_shares, common, shares) in refs.items():
        mine = (langs == name) | (langs == "")
        if not mine.any():
            continue
        used = mine[owner]
        h, o = hashes[used], owner[used]
        at = np.searchsorted(common, h)
        at[at == len(common)] = 0
        bin_of = np.where(common[at] == h, at, len(common)) if len(common) else np.zeros(len(h), dtype=np.int64)
        wide = len(common) + 1
        counts = np.bincount(o * wide + bin_of, minlength=n * wide).reshape(n, wide).astype(np.float64)
        for row, (c, s) in enumerate(((classes, class_shares), (counts, shares))):
            found = np.where(mine, js_distance(c, s), np.inf)
            best[row] = np.minimum(best[row], found)
    best[~np.isfinite(best)] = 0.0
    return best[0], best[1]


def scorer(refs: dict):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        symbol = np.zeros(256, dtype=bool)
        symbol[[ord(c) for c in "#*$%&|<>"]] = True
        for batch in slices(batches, "text"):
            texts = texts_of(batch.column("text"))
            starts, ends, owner, sums, hashes = word_hashes(texts, hasher)
            n_words = per_text(texts, owner)
            first = np.zeros(len(texts.data) + 1, dtype=np.int64)
            np.cumsum((texts.data & 0xC0) != 0x80, out=first[1:])
            chars = np.bincount(owner, weights=first[ends] - first[starts], minlength=len(texts)).astype(np.int64)
            total = np.zeros(len(texts.data) + 1, dtype=np.int64)
            np.cumsum(symbol[texts.data], out=total[1:])
            symbols = total[texts.offsets[1:]] - total[texts.offsets[:-1]]
            line_start, line_end, line_owner = texts.lines()
            has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
            line_start, line_end, line_owner = line_start[has_word], line_end[has_word], line_owner[has_word]
            _, seen = repeated_in_text(hasher.spans(sums, line_start, line_end), line_owner)
            windows = runs_of(hashes, 5)
            whole = owner[: len(windows)] == owner[4:] if len(windows) else np.zeros(0, dtype=bool)
            at = np.flatnonzero(whole)
            twice, _ = repeated_in_text(windows[at], owner[at])
            edge = np.zeros(len(owner) + 1, dtype=np.int32)
            np.add.at(edge, at[twice], 1)
            np.add.at(edge, at[twice] + 5, -1)
            repeat = per_text(texts, owner, np.cumsum(edge[:-1]) > 0)
            failed = (n_words < 10) | (100 * repeat > 20 * n_words)
            by_class, by_word = distances(texts, batch.column("lang").to_pylist(), owner, hashes, refs)
            noise = 1.0 / np.sqrt(np.maximum(1, n_words))
            odd = (by_class > CLASS_LIMIT + CLASS_NOISE * noise) | (by_word > WORD_LIMIT + WORD_NOISE * noise)
            kept = ~failed & ~(odd & (n_words >= MIN_WORDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in batch.schema.names if c not in ("text", "lang")]
                + [pa.array(x) for x in (n_words, chars, symbols, per_text(texts, line_owner, seen), repeat, failed, kept, by_class, by_word)],
                names=[c for c in batch.schema.names if c not in ("text", "lang")] + MEASURES,
            )

    return score


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"]
KINDS = ["long"] * 5 + ["boolean"] * 2 + ["double"] * 2


def judge(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of every document; `kept` is the verdict."""
    schema = ", ".join(["doc_id long", *(f"{n} {k}" for n, k in zip(MEASURES, KINDS, strict=True))])
    return docs.select("doc_id", "lang", "text").mapInArrow(scorer(references(docs)), schema)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns: the text stays in its row, nothing is joined."""
    refs = references(docs)
    score = scorer(refs)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 23):
            columns = batch.select(["text", "lang"])
            verdicts = [b.column("kept") for b in score(iter([columns]))]
            yield batch.filter(pa.chunked_array(verdicts).combine_chunks())

    return docs.mapInArrow(passing, docs.schema)
