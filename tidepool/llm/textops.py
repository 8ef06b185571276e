"""Vectorised helpers over Arrow batches of text, used inside Spark tasks.

A batch is read as one UTF-8 byte buffer with row offsets. All word classes of
this package separate words at ASCII bytes only, so splitting bytes is the same
as splitting characters. Hashes are polynomial prefix sums modulo 2**64 followed
by a mixer; equal sequences always have equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE2 = 0xD6E8FEB86659FD93 | 1


def _table(separators) -> np.ndarray:
    t = np.ones(256, dtype=bool)
    t[list(separators)] = False
    return t


#: Word bytes of the class of everything but white space.
SPACED = _table([0x20, *range(0x09, 0x0E)])
#: Word bytes of the class of digits, lower-case letters and everything beyond ASCII.
ALNUM = _table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class _Powers:
    """Powers of a base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.p = self.q = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.p) <= n:
            size = max(2 * len(self.p), n + 1)
            self.p, self.q = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, dtype=np.uint64))])
                              for b in (self.base, self.inverse))
        return self.p, self.q


_POWERS = {_BASE: _Powers(_BASE), _BASE2: _Powers(_BASE2)}


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(values: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Prefix sums of ``values[i] * base**i``."""
    p, _ = _POWERS[base].upto(len(values))
    c = np.empty(len(values) + 1, dtype=np.uint64)
    c[0] = 0
    np.cumsum(values * p[:len(values)], out=c[1:])
    return c


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hash of values[start:end] for each pair, the same wherever the values stand."""
    _, q = _POWERS[base].upto(len(sums))
    lengths = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * q[starts] + lengths * np.uint64(0xA0761D6478BD642F))


def gram_hash(values: np.ndarray, k: int, base: int = _BASE) -> np.ndarray:
    """Hash of every k consecutive values (len(values) - k + 1 of them, or none)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    c = prefix_sums(values, base)
    _, q = _POWERS[base].upto(n)
    return mix((c[k:] - c[:n]) * q[:n])


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """One byte buffer and the row offsets in it; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    kind = np.int64 if wide else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=kind, count=len(column) + 1,
                            offset=column.offset * np.dtype(kind).itemsize).astype(np.int64)
    if buffers[2] is None or offsets[-1] == offsets[0]:
        return np.empty(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into pieces of about ``limit`` bytes of text (one row at least).

    At the end, what Arrow holds free goes back to the system: the worker lives on, with other tasks.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    w = inside[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = w[:-1]
    starts = np.flatnonzero(w & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = w[1:]
    ends = np.flatnonzero(w & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    return range_hash(prefix_sums(data.astype(np.uint64) + np.uint64(1), base), starts, ends, base)


def sliding(values: np.ndarray, w: int, op) -> np.ndarray:
    """``op`` (minimum or maximum) over every ``w`` consecutive values, by doubling."""
    n = len(values) - w + 1
    if n <= 0:
        return values[:0]
    out, span = values, 1
    while span * 2 <= w:
        out = op(out[:-span], out[span:])
        span *= 2
    return op(out[:n], out[w - span:w - span + n]) if span < w else out[:n]


def minimizers(grams: np.ndarray, valid: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the least gram of some window of ``w`` grams.

    ``valid[s]`` says whether the window that starts at s lies in one row.
    Which places of a window are chosen depends on the window's content only,
    so equal windows have equal chosen grams at equal places.
    """
    low = sliding(grams, w, np.minimum)
    if not len(low) or not valid.any():
        return np.empty(0, dtype=np.int64)
    low = np.where(valid[:len(low)], low, np.uint64(0))
    seen = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    best = sliding(seen, w, np.maximum)  # over the windows that hold each place
    covered = sliding(np.concatenate([np.zeros(w - 1, np.uint8), valid[:len(low)].astype(np.uint8),
                                      np.zeros(w - 1, np.uint8)]), w, np.maximum)
    return np.flatnonzero((best == grams) & (covered > 0))


def rows_of(first: np.ndarray, n: int) -> np.ndarray:
    """The row of each of n items, from each row's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first)) if n else np.empty(0, np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)
