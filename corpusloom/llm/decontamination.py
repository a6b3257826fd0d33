"""Benchmark decontamination by CGK embedding and bit-sampling LSH over item-sized windows.

No place at `SIMILARITY` or more is left out. Edits that leave a piece that similar destroy a bounded number of the
item's runs of four characters, and the others stand in the text on neighbouring diagonals (`spared`): only regions
with that many are looked at. A run counts once, however often it stands there, and the item's most frequent runs may
be left out if as many fewer are asked for. In a region the item's parts of up to 64 characters are run bit by bit
through the text on its diagonals, many regions at once; the sum of their least distances is a lower bound of the edit
distance (`hopeful`).

The CGK walk reads a string with random bits: at each step it writes the current character and moves on if the
bit for (step, character) is one, so strings at a small edit distance give outputs at a small Hamming distance.
In each region that is left the window at its start diagonal is embedded together with the item; `tables` samples of
`BITS` positions are compared. The number of tables follows from how often positions agree for items mutated down to
`SIMILARITY`, measured on all items of the block. A window that agrees in one of them is verified closely around;
the rest of a region, and regions without agreement, are verified as a whole, so what the walk forgets is not lost.
Verification is the exact edit distance between the item and the piece of the text with the fewest edits; what lies
before and after that piece is searched again. All pieces at SIMILARITY or more are reported.

Strings are lower-cased words joined by one space. Items come in blocks of bounded size; each block is one pass
over the texts. Null and empty texts and items match nothing; repeated items and rows are each reported; a null
doc_id is reported as such. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import Hasher, slices

SIMILARITY = 0.8
RECALL = 0.95
BITS = 2
BLOCK_ITEMS, BLOCK_BYTES = 4096, 4 << 20
GRAM, SPARED = 4, 4
RUN_TABLE = 1 << 23
TEXT_BYTES = 2 << 20
CELLS = 2  # cells of diagonals for each stretch that an item's edits may shift
CROWD = 200  # windows of an item in a slice from which on repeated runs are told apart
LANES, PART = 4096, 64


def walk(chars: np.ndarray, length: np.ndarray, steps: int) -> np.ndarray:
    """CGK embeddings of rows of characters; positions past the end write -1."""
    rng = np.random.default_rng(4242)
    bits = rng.integers(0, 2, (steps, 256), dtype=np.int64)
    at = np.zeros(len(chars), dtype=np.int64)
    rows = np.arange(len(chars))
    out = np.full((len(chars), steps), -1, dtype=np.int16)
    padded = np.concatenate((chars, np.zeros((len(chars), 1), dtype=chars.dtype)), axis=1)
    for j in range(steps):
        live = at < length
        c = padded[rows, np.minimum(at, length)].astype(np.int64)
        out[live, j] = c[live]
        at += np.where(live, bits[j, c & 255], 0)
    return out


def embed(texts: list[str], steps: int) -> np.ndarray:
    codes = [np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)[:steps] for t in texts]
    length = np.array([len(c) for c in codes])
    chars = np.zeros((len(codes), max(1, int(length.max()))), dtype=np.uint32)
    for i, c in enumerate(codes):
        chars[i, : length[i]] = c
    return walk((chars % 32749).astype(np.int16), length, steps)


def edits_within(item: str, text: str) -> tuple[int, int]:
    """Least edit distance of the item to any piece of the text, and where that piece ends (bit-parallel)."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, distance, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | down
        d0 = ((((x & up) + up) ^ up) | x) & full
        plus = (down | ~(d0 | up)) & full
        minus = d0 & up
        distance += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = (minus | ~(d0 | plus)) & full, d0 & plus
        if distance < best:
            best, end = distance, j + 1
    return best, end


def spared(m: int, q: int) -> int:
    """Runs of `q` characters of an item of `m` that are left in every piece at SIMILARITY or more."""
    worst = 0
    for inserted in range(shift_of(m) + 1):
        others = math.floor((1 - SIMILARITY) * (m + inserted) - inserted + 1e-9)
        if others >= 0:
            worst = max(worst, q * others + (q - 1) * inserted)
    return m - q + 1 - worst


def shift_of(m: int) -> int:
    """The most edits of a piece at SIMILARITY or more: it is at most that much longer than the item."""
    return math.floor((1 / SIMILARITY - 1) * m + 1e-9)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def grams_of(codes: np.ndarray, q: int) -> np.ndarray:
    """Every run of `q` characters as a number; four characters of 16 bits or less are told apart exactly."""
    n = max(0, len(codes) - q + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(q):
        out = (out << np.uint64(16)) + codes[j : j + n]
    return out


class Items:
    """One block of items: their runs of characters, the bit masks of their parts and sampled positions."""

    def __init__(self, rows: list[tuple[int | None, str | None]]) -> None:
        rows = [(i, " ".join(t.lower().split())) for i, t in rows if t and t.split()]
        self.ids = [i for i, _ in rows]
        self.texts = [t for _, t in rows]
        codes = [codes_of(t) for t in self.texts]
        self.length = np.array([len(c) for c in codes], dtype=np.int64)
        # Long runs where enough of them must be left, shorter ones for short items.
        self.size, self.needed = [], []
        for m in self.length:
            q = next((q for q in range(GRAM, 1, -1) if spared(int(m), q) >= SPARED), 1)
            self.size.append(q)
            self.needed.append(max(1, spared(int(m), q)))
        self.vocabulary: dict[int, np.ndarray] = {}
        self.grams: list[np.ndarray] = [np.empty(0, dtype=np.int64)] * len(rows)
        for q in sorted(set(self.size)):
            own = [i for i, size in enumerate(self.size) if size == q]
            runs = [grams_of(codes[i], q) for i in own]
            self.vocabulary[q], number = np.unique(np.concatenate(runs), return_inverse=True)
            for i, part in zip(own, np.split(number, np.cumsum([len(r) for r in runs])[:-1]), strict=True):
                self.grams[i] = part
        # Bit masks of the parts of each item by character; the last column is for all other characters.
        self.alphabet = np.unique(np.concatenate(codes)) if codes else np.empty(0, dtype=np.uint32)
        self.parts = [math.ceil(len(c) / PART) for c in codes]
        self.first_part = np.cumsum(self.parts) - self.parts if codes else np.empty(0, dtype=np.int64)
        self.masks = np.zeros((sum(self.parts), len(self.alphabet) + 1), dtype=np.uint64)
        self.width = np.zeros(sum(self.parts), dtype=np.int64)
        for i, c in enumerate(codes):
            letters = np.searchsorted(self.alphabet, c)
            part = self.first_part[i] + np.arange(len(c)) // PART
            width = np.bincount(part - self.first_part[i])
            self.width[self.first_part[i] : self.first_part[i] + self.parts[i]] = width
            spare = np.repeat(PART - width, width)
            np.bitwise_or.at(self.masks, (part, letters), np.uint64(1) << (np.arange(len(c)) % PART + spare).astype(np.uint64))
        self.masks |= ((np.uint64(1) << (PART - self.width - 1).astype(np.uint64)) * np.uint64(2) - np.uint64(1))[:, None] * (self.width < PART)[:, None]
        # Numbers of letters and of runs by their letters, made where they are used.
        self.letter: np.ndarray | None = None
        self.run: dict[int, np.ndarray] = {}
        self.samples = np.random.default_rng(99).random((self.tables(), BITS))
        # What the walk over each item writes at the sampled positions, which lie in the steps that read it.
        self.sampled = np.zeros((len(rows), *self.samples.shape), dtype=np.int16)
        for i, text in enumerate(self.texts):
            self.sampled[i] = embed([text], 2 * len(text))[0][(self.samples * 2 * len(text)).astype(np.int64)]

    def tables(self) -> int:
        """Tables needed for RECALL at SIMILARITY, on average over all items mutated that much."""
        rng = np.random.default_rng(5)
        pairs = []
        for text in self.texts:
            if len(text) < 2:
                continue
            chars = list(text)
            for _ in range(max(1, int((1 - SIMILARITY) * len(text)))):
                at, kind = int(rng.integers(0, max(1, len(chars)))), rng.integers(0, 3)
                other = text[int(rng.integers(0, len(text)))]
                if kind == 0 and len(chars) > 1:
                    del chars[at]
                else:
                    chars[at : at + (kind == 1)] = [other]
            pairs.append((text, "".join(chars)))
        pairs.sort(key=lambda p: len(p[0]))
        shares = []
        for at in range(0, len(pairs), 64):
            part = pairs[at : at + 64]
            steps = 2 * max(len(a) for a, _ in part)
            same = embed([a for a, _ in part], steps) == embed([b for _, b in part], steps)
            shares += [max(0.01, float(row[: 2 * len(a)].mean())) for row, (a, _) in zip(same, part, strict=True)]
        if not shares:
            return 1
        missed = np.log1p(-np.minimum(0.999, np.array(shares)) ** BITS)
        many = 1
        while float(np.exp(many * missed).mean()) > 1 - RECALL:
            many = math.ceil(many * 1.1)
        return many

    def letters(self, codes: np.ndarray) -> np.ndarray:
        """The place of every character in the alphabet; one past its end for all others."""
        other = len(self.alphabet)
        if other and self.alphabet[-1] < 1 << 16:
            if self.letter is None:
                self.letter = np.full(1 << 16, other, dtype=np.int32)
                self.letter[self.alphabet] = np.arange(other)
            out = self.letter[np.minimum(codes, 0xFFFF)]
            if codes.size and codes.max() >= 1 << 16:
                out[codes >= 1 << 16] = other
            return out
        out = np.searchsorted(self.alphabet, codes).astype(np.int32)
        out[self.alphabet[np.minimum(out, other - 1)] != codes] = other
        return out

    def known_runs(self, codes: np.ndarray, letters: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
        """The runs of `q` characters that an item has: their numbers and where they start."""
        vocabulary, base = self.vocabulary[q], len(self.alphabet) + 1
        if base**q > RUN_TABLE or self.alphabet[-1] >= 1 << 16:
            runs = grams_of(codes, q)
            number = np.minimum(np.searchsorted(vocabulary, runs), len(vocabulary) - 1)
            at = np.flatnonzero(vocabulary[number] == runs)
            return number[at], at
        if q not in self.run:
            spelt = np.zeros(len(vocabulary), dtype=np.int64)
            for j in range(q):
                letter = (vocabulary >> np.uint64(16 * (q - 1 - j))) & np.uint64(0xFFFF)
                spelt = spelt * base + np.searchsorted(self.alphabet, letter.astype(np.uint32))
            self.run[q] = np.full(base**q, -1, dtype=np.int32)
            self.run[q][spelt] = np.arange(len(vocabulary))
        many = max(0, len(letters) - q + 1)
        runs = letters[:many].copy()
        for j in range(1, q):
            runs *= np.int32(base)
            runs += letters[j : j + many]
        number = self.run[q][runs]
        at = np.flatnonzero(number >= 0)
        return number[at], at

    def regions(self, codes: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, start, end) of every region of a slice that may hold an item; regions of an item may overlap."""
        found: list[tuple[np.ndarray, ...]] = []
        for q, vocabulary in self.vocabulary.items():
            number, at = self.known_runs(codes, letters, q)
            if not len(at):
                continue
            narrow = number.astype(np.uint16 if len(vocabulary) <= 1 << 16 else np.int32)
            places = at[np.argsort(narrow, kind="stable")].astype(np.int32)
            many = np.bincount(number, minlength=len(vocabulary))
            first = np.cumsum(many) - many
            for i, size in enumerate(self.size):
                if size == q:
                    found.append((np.int64(i), *self.dense(i, places, first, many, len(codes))))
        if not found:
            none = np.empty(0, dtype=np.int64)
            return none, none, none
        items = np.concatenate([np.full(len(a), i) for i, a, _ in found])
        return items, np.concatenate([a for _, a, _ in found]), np.concatenate([b for _, _, b in found])

    def dense(self, i: int, places: np.ndarray, first: np.ndarray, many: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the regions in which enough runs of an item stand on neighbouring diagonals."""
        own, m = self.grams[i], int(self.length[i])
        shift = shift_of(m)
        cell = max(1, (shift + 1) // CELLS)
        span = -(-shift // cell) + 1
        count = many[own]
        if np.count_nonzero(count) < self.needed[i]:
            none = np.empty(0, dtype=np.int64)
            return none, none
        # Of the runs that must be left, some may be the most frequent ones: without these as many fewer must be found.
        order = np.argsort(-count, kind="stable")
        chance = (count.sum() - np.cumsum(count[order]) + count[order])[: self.needed[i]] * (span * cell / n)
        # By how many standard deviations that is more than a window has by chance.
        sure = (self.needed[i] - np.arange(len(chance)) - chance) / np.sqrt(chance + 1e-9)
        dropped = int(np.argmax(sure))
        needed = self.needed[i] - dropped
        at = np.sort(order[dropped:])
        at = at[count[at] > 0]
        own, count = own[at], count[at]
        if len(own) < needed:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        # The run at place p of the item, found at x, lies on diagonal x - p; m is added so that none is negative.
        begin = np.cumsum(count) - count
        found = [places[a : a + c] for a, c in zip(first[own].tolist(), count.tolist(), strict=True)]
        # One cell more, so that sums begin with none.
        at_cell = np.concatenate(found)
        at_cell += np.repeat((m + cell - at).astype(np.int32), count)
        at_cell //= np.int32(cell)
        sums = np.bincount(at_cell, minlength=(n + m) // cell + span + 2)
        np.cumsum(sums, out=sums)
        sums = sums[span:] - sums[:-span]
        hit = np.flatnonzero(sums >= needed)
        if len(hit) > CROWD:
            # A run counts once in a window of cells, however often it stands there.
            twice = at_cell[1:] - at_cell[:-1] < span
            twice[begin[1:] - 1] = False
            twice = np.flatnonzero(twice)
            less = np.bincount(np.maximum(0, at_cell[1:][twice] - span), minlength=len(sums))
            less -= np.bincount(at_cell[twice], minlength=len(sums))
            sums -= np.cumsum(less, out=less)
            hit = np.flatnonzero(sums >= needed)
        if not len(hit):
            return hit, hit
        # Windows that follow each other become one region, but none much longer than the item.
        fresh = np.append(True, np.diff(hit) > 1)
        run = np.cumsum(fresh) - 1
        piece = (hit - hit[fresh][run]) // max(1, m // cell)
        fresh |= np.append(True, np.diff(piece) != 0)
        last = np.append(np.flatnonzero(fresh)[1:] - 1, len(hit) - 1)
        return hit[fresh] * cell - m, (hit[last] + span) * cell

    def hopeful(self, letters: np.ndarray, item: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether the least distances of an item's parts to a region sum up to few enough edits (bit-parallel)."""
        n = len(letters)
        letters = np.append(letters, np.int32(len(self.alphabet)))
        allowed = (1 / SIMILARITY - 1) * self.length[item] + 1e-9
        total = np.zeros(len(item), dtype=np.int64)
        parts = np.array(self.parts)[item]
        for number in range(int(parts.max()) if len(item) else 0):
            # Regions whose first parts already need too many edits are done.
            live = np.flatnonzero((parts > number) & (total <= allowed))
            # A part stands on the region's diagonals, so only there is it looked for.
            part = self.first_part[item[live]] + number
            low = np.maximum(0, start[live] + number * PART)
            size = np.minimum(n, (end - self.length[item])[live] + number * PART + self.width[part]) - low
            order = np.argsort(size, kind="stable")
            for at in range(0, len(live), LANES):
                lanes = order[at : at + LANES]
                total[live[lanes]] += self.least(letters, part[lanes], low[lanes], int(size[lanes].max()))
        return total <= allowed

    def least(self, letters: np.ndarray, part: np.ndarray, start: np.ndarray, steps: int) -> np.ndarray:
        """The least edit distance of each part to any piece of the text from its start on, all parts side by side."""
        table, base, beyond = self.masks.ravel(), part * self.masks.shape[1], len(letters) - 1
        # Parts end at the highest bit; what lies below a shorter one matches everything.
        distance = self.width[part].copy()
        best = distance.copy()
        up = ~np.uint64(0) << (PART - distance).astype(np.uint64)
        down = np.zeros(len(part), dtype=np.uint64)
        one, x = np.uint64(1), start.copy()
        for _ in range(steps):
            eq = table.take(base + letters.take(x, mode="clip"))
            d0 = eq & up
            d0 += up
            d0 ^= up
            d0 |= eq
            d0 |= down
            plus = d0 | up
            np.invert(plus, out=plus)
            plus |= down
            minus = np.bitwise_and(d0, up, out=up)
            distance -= plus.view(np.int64) >> 63
            distance += minus.view(np.int64) >> 63
            np.minimum(best, distance, out=best)
            plus <<= one
            minus <<= one
            down = plus & d0
            np.bitwise_or(plus, d0, out=d0)
            np.invert(d0, out=d0)
            up = np.bitwise_or(minus, d0, out=d0)
            x += 1
        return best

    def agree(self, item: np.ndarray, windows: list[str]) -> np.ndarray:
        """Whether a window's walk meets the item's in one of the tables."""
        out = np.zeros(len(item), dtype=bool)
        order = np.argsort(self.length[item], kind="stable")
        for at in range(0, len(order), 1024):
            part = order[at : at + 1024]
            steps = 2 * self.length[item[part]]
            embedded = embed([windows[i] for i in part], int(steps.max()))
            places = (self.samples[None] * steps[:, None, None]).astype(np.int64)
            got = embedded[np.arange(len(part))[:, None, None], places]
            out[part] = (got == self.sampled[item[part]]).all(axis=2).any(axis=1)
        return out


def pieces(item: str, text: str, near: tuple[int, int] | None) -> Iterator[tuple[int, int, float]]:
    """(start, end, similarity) of the pieces of a text that are similar to the item; `near` is looked at first."""
    m = len(item)
    left = [(0, len(text))]
    while left:
        low, high = left.pop()
        a, b = (low, high) if near is None else near
        whole, near = near is None, None
        distance, end = edits_within(item, text[a:b])
        if distance <= (1 / SIMILARITY - 1) * m + 1e-9 and end:
            _, back = edits_within(item[::-1], text[a : a + end][::-1])
            start, end = a + end - back, a + end
            similarity = 1 - distance / max(m, back)
            good = similarity >= SIMILARITY - 1e-9
            if good and (start == a > low or end == b < high):
                # What reaches the edge may go on beyond it.
                near = (max(low, a - m), min(high, b + m))
                left.append((low, high))
                continue
            if good:
                yield start, end, similarity
            if whole or good:
                left += [(x, y) for x, y in ((low, start), (end, high)) if y - x >= SIMILARITY * m - 1e-9 and y - x < high - low]
                continue
        if not whole:
            left.append((low, high))


def matches(items: Items, column: pa.Array, hasher: Hasher) -> list[tuple[int, int, int, int, float]]:
    """(text, item, first word, last word, similarity) of every contaminated place of a slice of texts."""
    texts = [" ".join(t.lower().split()) if t else "" for t in column.to_pylist()]
    if not items.ids or not any(texts):
        return []
    joined = "\n".join(texts)
    codes = codes_of(joined)
    offset = np.cumsum([0] + [len(t) + 1 for t in texts])
    letters = items.letters(codes)
    item, start, end = items.regions(codes, letters)
    if not len(item):
        return []
    kept = items.hopeful(letters, item, start, end)
    item, start, end = item[kept], np.maximum(0, start[kept]), np.minimum(len(codes), end[kept])
    # Regions of an item that touch become one, then they are cut at the ends of texts.
    order = np.lexsort((start, item))
    item, start, end = item[order], start[order], end[order]
    spans: list[list[int]] = []
    for i, a, b in zip(item.tolist(), start.tolist(), end.tolist(), strict=True):
        if spans and spans[-1][0] == i and a <= spans[-1][2]:
            spans[-1][2] = max(spans[-1][2], b)
        else:
            spans.append([i, a, b])
    looked = []
    for i, a, b in spans:
        row = int(np.searchsorted(offset, a, side="right")) - 1
        while row < len(texts) and offset[row] < b:
            low, high = max(a, int(offset[row])), min(b, int(offset[row + 1]) - 1)
            if high - low >= SIMILARITY * items.length[i] - 1e-9:
                looked.append((row, i, low, high))
            row += 1
    if not looked:
        return []
    which = np.array([i for _, i, _, _ in looked])
    laid = []
    for _, i, low, high in looked:
        m = int(items.length[i])
        a = low + max(0, min(shift_of(m) // 2, high - low - m))
        laid.append((a, min(high, a + m)))
    agree = items.agree(which, [joined[a:b] for a, b in laid])
    out: dict[tuple[int, int, int], tuple[int, float]] = {}
    for (row, i, low, high), (a, b), met in zip(looked, laid, agree, strict=True):
        slack = shift_of(int(items.length[i]))
        near = (max(0, a - slack - low), min(high, b + slack) - low) if met else None
        for begin, stop, similarity in pieces(items.texts[i], joined[low:high], near):
            begin, stop = low + begin, low + stop
            word = joined.count(" ", int(offset[row]), begin)
            last = joined.count(" ", int(offset[row]), max(stop - 1, begin))
            out.setdefault((row, i, word), (last, similarity))
    return [(row, i, word, last, s) for (row, i, word), (last, s) in out.items()]


def blocks(benchmark: DataFrame) -> Iterator[Items]:
    """Items by blocks of bounded number and bytes."""
    known = benchmark.where("text is not null")
    size = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    many = max(1, -(-size["n"] // BLOCK_ITEMS), -(-(size["b"] or 0) // BLOCK_BYTES))
    for i in range(many):
        part = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == i)
        yield Items(sorted(((r["item_id"], r["text"]) for r in part.select("item_id", "text").collect()), key=str))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, last_word and similarity of every benchmark item found in a document."""

    def finder(items: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher = Hasher()
            for batch in slices(batches, "text", TEXT_BYTES):
                found = matches(items, batch.column("text"), hasher)
                ids = batch.column("doc_id").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[f[0]] for f in found], pa.int64()),
                        pa.array([items.ids[f[1]] for f in found], pa.int64()),
                        pa.array([f[2] for f in found], pa.int64()),
                        pa.array([f[3] for f in found], pa.int64()),
                        pa.array([f[4] for f in found], pa.float64()),
                    ],
                    names=["doc_id", "item_id", "first_word", "last_word", "similarity"],
                )

        return run

    schema = "doc_id long, item_id long, first_word long, last_word long, similarity double"
    texts = docs.select("doc_id", "text").where("text is not null")
    return reduce(DataFrame.unionByName, [texts.mapInArrow(finder(items), schema) for items in blocks(benchmark)])


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item was found, with all their columns."""
    out = docs
    for items in blocks(benchmark):

        def clean(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            hasher = Hasher()
            for batch in slices(batches, "text", TEXT_BYTES):
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[f[0] for f in matches(items, batch.column("text"), hasher)]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(clean, docs.schema)
    return out
