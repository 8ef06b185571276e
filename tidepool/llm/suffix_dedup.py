"""Suffix-array dedup with a logarithmic family of indexes.

Every 200-byte string that starts at more than one place is found, and all its
occurrences are removed. Text that can recur is routed by anchors (see anchors.py), so
the suffixes that might share 200 bytes meet in one shard. A shard takes its segments
in batches. A batch gets a suffix array: its suffixes in the order of their first 200
bytes, compared by a 128-bit fingerprint (any total order of these prefixes brings
equal ones together, and this one needs no byte comparisons). The array is scanned
for equal neighbours, merge-scanned against each existing level for long matches, and
added as a new level; levels of like size are merged, so a shard that has taken n
suffixes keeps O(log n) levels. A level keeps one entry for each distinct suffix, and
levels are dropped when their anchor is done.

Cases: a null or empty text has no bytes; rows that share a doc_id or have none are documents of
their own; rows equal in id and text are one document,
so equal places of theirs are one place, and a span found in one is applied to each;
matches never cross documents; other columns are not read; an empty table gives an
empty result. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidepool.llm.anchors import SPANS, Units, blocks, marked, runs, segments, span_batch, with_spans
from tidepool.llm.session_tools import ready
from tidepool.llm.textops import _BASE2, _BASE, _POWERS, mix, prefix_sums, rows_of, slices, text_bytes

MATCH_BYTES = 200
GRAM_BYTES = 64
BLOCK_BYTES = 1 << 20


def fingerprints(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the n bytes from each place."""
    out = []
    for base in (_BASE, _BASE2):
        c = prefix_sums(data.astype(np.uint64) + np.uint64(1), base)
        _, q = _POWERS[base].upto(len(c))
        out.append(mix((c[at + n] - c[at]) * q[at]))
    return out[0], out[1]


class Level:
    """A suffix array: distinct suffixes in order, one place each, and whether it has been reported."""

    def __init__(self, a, b, place, told):
        self.a, self.b, self.place, self.told = a, b, place, told

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge scan: which of the sorted suffixes stand here, and where."""
        at = np.minimum(np.searchsorted(self.a, a), len(self.a) - 1)
        hit = (self.a[at] == a) & (self.b[at] == b)
        return hit, at

    def merged(self, other: Level) -> Level:
        joined = [np.concatenate([x, y]) for x, y in zip(self.columns(), other.columns(), strict=True)]
        order = np.argsort(joined[0], kind="stable")
        return Level(*(x[order] for x in joined))

    def columns(self):
        return self.a, self.b, self.place, self.told


class Family:
    """The levels of one shard."""

    def __init__(self):
        self.levels: list[Level] = []

    def add(self, a, b, place, many) -> tuple[np.ndarray, list[np.ndarray]]:
        """Take a batch. Returns which of its suffixes recur, and places (document, text, byte) of older ones that now do.

        ``many``: suffixes whose segment has several places already.
        """
        order = np.lexsort((b, a))  # the batch's suffix array
        sa, sb = a[order], b[order]
        same = (sa[1:] == sa[:-1]) & (sb[1:] == sb[:-1])
        elsewhere = same & (place[order][1:] != place[order][:-1]).any(axis=1)
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        group = np.cumsum(np.concatenate([[True], ~same])) - 1
        recurs = np.zeros(len(first), dtype=bool)
        recurs[group[1:][elsewhere]] = True
        recurs[group[many[order]]] = True
        one = order[first]  # an entry of each distinct suffix
        keep = np.ones(len(first), dtype=bool)
        older = []
        for level in self.levels:
            hit, at = level.find(a[one], b[one])
            moved = hit & (level.place[at] != place[one]).any(axis=1)
            recurs |= moved | (hit & level.told[at])
            late = np.unique(at[hit & recurs & ~level.told[at]])
            older.append(level.place[late])
            level.told[late] = True
            keep &= ~hit
        new = one[keep]
        self.push(Level(a[new], b[new], place[new], recurs[keep].copy()))
        out = np.zeros(len(a), dtype=bool)
        out[order] = recurs[group]
        return out, older

    def push(self, level: Level) -> None:
        if not len(level.a):
            return
        self.levels.append(level)
        while len(self.levels) > 1 and len(self.levels[-2].a) <= 2 * len(self.levels[-1].a):
            top = self.levels.pop()
            self.levels[-1] = self.levels[-1].merged(top)


def repeated(docs: DataFrame, n: int = MATCH_BYTES, gram: int = GRAM_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text_hash, start, stop of byte ranges whose n-byte strings all start elsewhere too (ranges may overlap)."""
    units = Units(words=False, window=n, gram=gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Family()
        for block in blocks(batches, block_bytes):
            segment = rows_of(block.offsets, len(block.data))
            at = np.flatnonzero(np.arange(len(block.data)) + n <= block.offsets[segment + 1])
            owner = segment[at]
            several = np.array([len(np.unique(block.places[i:j], axis=0)) > 1 if j - i > 1 else False
                                for i, j in zip(block.first[:-1], block.first[1:], strict=True)])
            a, b = fingerprints(block.data, at, n)
            # The last anchor may go on: then the family must know its suffixes only.
            lead = block.places[block.first[owner]]
            inside = at - block.offsets[owner]
            lead = np.column_stack([lead[:, :2], lead[:, 2] + inside])
            flags, older = family.add(a, b, lead, several[owner])
            for place in older:
                if len(place):
                    yield span_batch(place, 0, n)
            begin, end = runs(flags, owner)
            who = owner[begin]
            copies = block.first[who + 1] - block.first[who]
            which = np.repeat(np.arange(len(who)), copies)
            index = np.arange(len(which)) - np.repeat(np.cumsum(copies) - copies, copies) + block.first[who][which]
            where = block.places[index]
            if len(where):
                yield span_batch(where, inside[begin][which], inside[end][which] + n)
            if not block.goes_on:
                family = Family()

    return segments(docs, units).mapInArrow(run, SPANS)


def digests(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column(1))
            gone = marked(batch.column(2), offsets, len(data))
            row = rows_of(offsets, len(data))
            begin, _ = runs(gone, row)
            rows = batch.num_rows
            kept, keep = data[~gone].tobytes(), np.bincount(row[~gone], minlength=rows)
            ends = np.cumsum(keep)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(np.bincount(row[gone], minlength=rows)),
                 pa.array(np.bincount(row[begin], minlength=rows)),
                 pa.array([hashlib.sha256(kept[e - k:e]).hexdigest() for e, k in zip(ends.tolist(), keep.tolist(), strict=True)])],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_spans(docs, repeated(docs, **parameters)).mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
