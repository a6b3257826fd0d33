"""Arrow batches of texts as flat byte arrays, with vectorised words, lines and hashes.

Texts are laid one after another with a newline after each, so that no word or line crosses two texts.
Words are runs of bytes that are no ASCII white space. Hashes are 64-bit polynomial hashes, mixed; they
depend on the bytes alone, so they agree between tasks and machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
SLICE_BYTES = 1 << 20


def white_table() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every other."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hasher:
    """Prefix sums of byte values times powers, from which any substring's hash is one subtraction."""

    def __init__(self) -> None:
        self.values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
        self.powers = np.ones(1, dtype=np.uint64)
        self.inverse = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = 2 * max(n, 1 << 16)
            for name, base in (("powers", BASE), ("inverse", INVERSE)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        sums = np.empty(len(data) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(self.values[data] * self.powers[: len(data)], out=sums[1:])
        return sums

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((sums[ends] - sums[starts]) * self.inverse[starts])


def runs_of(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive values; the caller masks runs that cross documents."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out = out * np.uint64(BASE) + h[j : j + n]
    return mixed(out)


class Texts:
    """One slice of texts: bytes, and the first byte of each text (`offsets`, closed by the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and texts of all words; `inside` tells by byte what belongs to one."""
        inside = (~white_table() if inside is None else inside)[self.data]
        before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(~inside & before)
        return starts, ends, np.searchsorted(self.offsets, starts, side="right") - 1

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and texts of all lines, empty ones included."""
        ends = np.flatnonzero(self.data == 10)
        starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
        return starts, ends, np.searchsorted(self.offsets, starts, side="right") - 1


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat bytes and offsets of a string or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    width = np.int64 if large else np.int32
    if len(column) == 0:
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(buffers[1], dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.empty(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts_of(column: pa.Array) -> Texts:
    raw, offsets = bytes_of(column)
    n = len(offsets) - 1
    data = np.full(len(raw) + n, 10, dtype=np.uint8)
    keep = np.ones(len(data), dtype=bool)
    keep[offsets[1:] + np.arange(n)] = False
    data[keep] = raw
    return Texts(data, offsets + np.arange(n + 1))


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about `size` bytes of `column`, or one longer text."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = bytes_of(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
