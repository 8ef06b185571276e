"""Routing of recurring text: what repeats anywhere meets in one place, in pieces.

A window of N units (words or bytes) is known by its anchor, the least hash among its
k-unit grams. Equal windows have equal anchors, whatever stands around them, so a
window can recur only if its anchor does. The steps:

1. every document's anchors are counted; few windows share one, so this is a small
   part of the text, and counts are combined before the shuffle;
2. places of anchors that recur are found by a semi join (a hot anchor is only split)
   and gathered by document;
3. each document's runs of windows with one recurring anchor become segments of text;
   equal segments of a task are combined into one row with all its places;
4. segments meet by anchor, ordered by first place, for an operator's own work.

Every step streams; no step holds more than a slice of text or one document.

A document is known by its doc_id and the hash of its text, so rows that share an id or have
none are documents of their own; rows equal in both are one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.session_tools import ready, stage, text_input
from tidepool.llm.textops import (
    SPACED, gram_hash, minimizers, mix, prefix_sums, range_hash, rows_of, signed, sliding, slices, spans, text_bytes, word_hashes,
)

#: Stands for a null doc_id in packed places.
NO_ID = -(1 << 63)
LONGEST_RUN = 4096
COMBINE_BYTES = 16 << 20


@dataclass(frozen=True)
class Units:
    """Windows of ``window`` words or bytes, known by grams of ``gram`` of them."""

    words: bool
    window: int
    gram: int

    @property
    def grams(self) -> int:
        return self.window - self.gram + 1

    def read(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, unit starts and ends in them, each row's first unit, and the units' values."""
        data, offsets = text_bytes(column)
        if self.words:
            starts, ends, first = spans(data, offsets, SPACED)
            return data, starts, ends, first, word_hashes(data, starts, ends)
        at = np.arange(len(data) + 1)
        return data, at[:-1], at[1:], offsets, data.astype(np.uint64) + np.uint64(1)

    def inside(self, row: np.ndarray) -> np.ndarray:
        """Whether the window that starts at each unit lies in one row."""
        n = len(row) - self.window + 1
        return row[:n] == row[self.window - 1:] if n > 0 else np.empty(0, dtype=bool)


def anchors(docs: DataFrame, units: Units, with_doc: bool) -> DataFrame:
    """anchor and either doc_id and text_hash or n (places): a row for each anchor of a document, or of a slice of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            _, _, _, first, values = units.read(batch.column(1))
            row = rows_of(first, len(values))
            grams = gram_hash(values, units.gram)
            at = minimizers(grams, units.inside(row), units.grams)
            if with_doc:
                _, one = np.unique(grams[at] + mix(row[at].astype(np.uint64) + np.uint64(1)), return_index=True)
                at = at[one]
                who = pa.array(row[at])
                yield pa.RecordBatch.from_arrays([pa.array(signed(grams[at])), batch.column(0).take(who), batch.column(2).take(who)],
                                                 names=["anchor", "doc_id", "text_hash"])
            else:
                known, n = np.unique(grams[at], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(known)), pa.array(n)], names=["anchor", "n"])

    return docs.mapInArrow(run, "anchor long, doc_id long, text_hash long" if with_doc else "anchor long, n long")


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, text, text_hash."""
    return text_input(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))


def segments(docs: DataFrame, units: Units) -> DataFrame:
    """anchor, doc_id, text_hash, place (of the first copy), text, places (doc_id, text hash and unit of each), by anchor."""
    spark = docs.sparkSession
    ready(spark)
    docs = hashed(docs)
    recurring = anchors(docs, units, False).groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    recurring = stage(recurring, "anchors")  # a table of its own, so that the join can split a hot anchor's places
    found = anchors(docs, units, True).join(recurring, "anchor", "left_semi")
    found = found.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.collect_set("anchor").alias("anchors"))
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found["d"]) & (docs["text_hash"] == found["h"])).select("doc_id", "text", "anchors", "text_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        size = 0
        for batch in slices(batches, "text"):
            data, starts, ends, first, values = units.read(batch.column(1))
            row = rows_of(first, len(values))
            low = sliding(gram_hash(values, units.gram), units.grams, np.minimum)
            inside = units.inside(row)
            if not len(inside):
                continue
            # Which windows have an anchor that recurs.
            lists = batch.column(2)
            known = np.asarray(lists.flatten()).view(np.uint64)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            known = np.sort(known + mix(owner.astype(np.uint64) + np.uint64(1)))
            key = low + mix(row[:len(low)].astype(np.uint64) + np.uint64(1))
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            use = inside & (known[at] == key)
            # Runs of windows with one anchor in one row.
            begins = use.copy()
            begins[1:] &= ~(use[:-1] & (low[1:] == low[:-1]) & (row[1:len(low)] == row[:len(low) - 1]))
            head = np.flatnonzero(begins)
            run_no = np.cumsum(begins) - 1
            ordinal = np.arange(len(low)) - head[np.maximum(run_no, 0)] if len(head) else np.empty(0, np.int64)
            begins = use & (ordinal % LONGEST_RUN == 0) if len(head) else begins
            head = np.flatnonzero(begins)
            if not len(head):
                continue
            length = np.bincount((np.cumsum(begins) - 1)[use], minlength=len(head))
            left, right = starts[head], ends[head + length + units.window - 2]
            print_of = range_hash(prefix_sums(data.astype(np.uint64) + np.uint64(1)), left, right)
            ids = np.asarray(batch.column(0).fill_null(NO_ID))
            hashes = np.asarray(batch.column(3))
            place = head - first[row[head]]
            raw = data.tobytes()
            for a, p, b, e, d, h, u in zip(signed(low[head]).tolist(), print_of.tolist(), left.tolist(), right.tolist(),
                                           ids[row[head]].tolist(), hashes[row[head]].tolist(), place.tolist(), strict=True):
                entry = held.get((a, p))
                if entry is None:
                    held[a, p] = [raw[b:e], d, h, u]
                    size += e - b + 100
                else:
                    entry += (d, h, u)
                    size += 24
            if size >= COMBINE_BYTES:
                yield from flush(held)
                held, size = {}, 0
        yield from flush(held)

    schema = "anchor long, doc_id long, text_hash long, place long, text binary, places binary"
    # Not cut at one row per key: rows of one anchor are distinct texts or come from different tasks.
    out = joined.mapInArrow(run, schema)
    return out.repartition(F.col("anchor")).sortWithinPartitions("anchor", "doc_id", "text_hash", "place")


def flush(held: dict) -> Iterator[pa.RecordBatch]:
    rows = []
    for (anchor, _), entry in held.items():
        places = sorted(set(zip(entry[1::3], entry[2::3], entry[3::3], strict=True)))
        rows.append((anchor, *places[0], entry[0], np.array(places, dtype=np.int64).tobytes()))
    for i in range(0, len(rows), 5000):
        columns = zip(*rows[i:i + 5000], strict=True)
        kinds = (*[pa.int64()] * 4, pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                         names=["anchor", "doc_id", "text_hash", "place", "text", "places"])


@dataclass
class Block:
    """Segments of whole anchors, or one part of a long anchor."""

    anchor: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    places: np.ndarray  # (doc_id, text hash, unit) of every copy
    first: np.ndarray  # each segment's first row in places
    goes_on: bool  # the last anchor has more segments in the next block


def blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[Block]:
    """The sorted segments in blocks of about ``limit`` bytes that end with an anchor where they can."""
    held: list[pa.RecordBatch] = []
    size = 0

    def block(parts: list[pa.RecordBatch], goes_on: bool) -> Block:
        t = pa.Table.from_batches(parts).combine_chunks()
        text, places = t["text"].to_pylist(), t["places"].to_pylist()
        counts = np.array([len(p) // 24 for p in places])
        return Block(np.asarray(t["anchor"]), np.frombuffer(b"".join(text), dtype=np.uint8),
                     np.concatenate([[0], np.cumsum([len(x) for x in text])]).astype(np.int64),
                     np.frombuffer(b"".join(places), dtype=np.int64).reshape(-1, 3),
                     np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), goes_on)

    for batch in slices_of_rows(batches, limit):
        keys = np.asarray(batch.column(0))
        if held and size >= limit:
            last = held[-1].column(0)[-1].as_py()
            cut = int(np.searchsorted(keys != last, True)) if (keys != last).any() else len(keys)
            if cut == 0:
                yield block(held, False)
                held, size = [], 0
            elif cut < len(keys):
                yield block([*held, batch.slice(0, cut)], False)
                held, size = [], 0
                batch = batch.slice(cut)
            else:
                yield block(held, True)
                held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield block(held, False)


def slices_of_rows(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, min(batch.num_rows, batch.num_rows * limit // max(batch.nbytes, 1)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def runs(flags: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of set flags in one segment."""
    begins = flags.copy()
    begins[1:] &= ~(flags[:-1] & (segment[1:] == segment[:-1]))
    ends = flags.copy()
    ends[:-1] &= ~(flags[1:] & (segment[1:] == segment[:-1]))
    return np.flatnonzero(begins), np.flatnonzero(ends)


SPANS = "doc_id long, text_hash long, start long, stop long"


def span_batch(places: np.ndarray, start: np.ndarray | int, stop: np.ndarray | int) -> pa.RecordBatch:
    """Spans of units from ``start`` to ``stop`` after each place."""
    ids = pa.array(places[:, 0], mask=places[:, 0] == NO_ID)
    return pa.RecordBatch.from_arrays([ids, pa.array(places[:, 1]), pa.array(places[:, 2] + start), pa.array(places[:, 2] + stop)],
                                      names=["doc_id", "text_hash", "start", "stop"])


def with_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text, spans (start, stop) of every document, those without any included."""
    docs = hashed(docs)
    found = found.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return docs.join(found, docs["doc_id"].eqNullSafe(found["d"]) & (docs["text_hash"] == found["h"]), "left").select("doc_id", "text", "spans")


def marked(lists: pa.ListArray, first: np.ndarray, n: int) -> np.ndarray:
    """Which of n units lie in any span of their row."""
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)) * np.asarray(lists.is_valid()))
    change = np.zeros(n + 1, dtype=np.int64)
    limit = first[row + 1]
    np.add.at(change, np.minimum(first[row] + np.asarray(flat.field(0)), limit), 1)
    np.add.at(change, np.minimum(first[row] + np.asarray(flat.field(1)), limit), -1)
    return np.cumsum(change[:n]) > 0
