"""Substring dedup by repeated-phrase automata.

A phrase is 20 consecutive words. Text that can hold a recurring phrase is routed by
anchors (see anchors.py): equal phrases meet in one shard, in the order of their first
places. A shard confirms which phrases recur, compiles them into an Aho-Corasick
automaton over word numbers (pyahocorasick), and streams every segment through it to
locate every occurrence. The first occurrence (smaller doc_id, then earlier start)
stays; words that any other covers are removed.

A shard's automaton holds the phrases of one block of segments. An anchor with more segments
than a block goes on in the next one: phrases of the next block that have been seen before
(known by 128-bit fingerprints and their first places) are confirmed, too, and go into its automaton.

Cases: a null or empty text has no words; rows that share a doc_id or have none are documents of
their own, in the order of their texts' hashes; rows equal in id and text are one document, so
equal places of theirs are one place, and a span found in one is applied to each; a
null doc_id counts as smaller than any; other columns are not read; an empty table
gives an empty result. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidepool.llm.anchors import SPANS, Block, Units, blocks, marked, runs, segments, span_batch, with_spans
from tidepool.llm.session_tools import ready
from tidepool.llm.textops import _BASE, _BASE2, SPACED, gram_hash, rows_of, slices, spans, text_bytes, word_hashes

PHRASE_WORDS = 20
GRAM_WORDS = 6
BLOCK_BYTES = 1 << 20


def automaton(numbers: list[int], starts: list[int], n: int) -> ahocorasick.Automaton:
    """An automaton of the phrases that start at the places; a phrase's value is its index."""
    a = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for i, s in enumerate(starts):
        a.add_word(tuple(numbers[s:s + n]), i)
    a.make_automaton()
    return a


class Shard:
    """Finds, block by block, phrases that have started earlier."""

    def __init__(self, n: int):
        self.n = n
        self.seen: dict[tuple[int, int], tuple] = {}  # of the anchor that goes on: phrases and their first places

    def take(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each phrase place of the block: its segment, its place in it, and whether it has an earlier copy."""
        n = self.n
        starts, ends, first = spans(block.data, block.offsets, SPACED)
        hashes = word_hashes(block.data, starts, ends)
        segment = rows_of(first, len(hashes))
        places = np.flatnonzero(np.arange(len(hashes)) + n <= first[segment + 1])
        a, b = gram_hash(hashes, n, _BASE)[places], gram_hash(hashes, n, _BASE2)[places]
        earlier = np.zeros(len(places), dtype=bool)
        # Confirmed phrases: those whose fingerprint stands twice in the block, or in an earlier block of its first anchor.
        order = np.argsort(a, kind="stable")
        same = a[order][1:] == a[order][:-1]
        recurs = np.zeros(len(places), dtype=bool)
        recurs[order[1:][same]] = recurs[order[:-1][same]] = True
        begin = np.ones(len(places), dtype=bool)
        begin[order[1:][same]] = False  # one place of each
        if self.seen:
            recurs |= np.fromiter((k in self.seen for k in zip(a.tolist(), b.tolist(), strict=True)), bool, len(places))
        chosen = np.flatnonzero(recurs & begin)
        if len(chosen):
            numbers = np.unique(hashes, return_inverse=True)[1].tolist()
            found = automaton(numbers, places[chosen].tolist(), n)
            # Where each phrase stands first: in an earlier block, or where it is first met.
            met = [self.seen.get((int(a[i]), int(b[i]))) for i in chosen.tolist()]
            lead = [tuple(x) for x in block.places[block.first[:-1]].tolist()]
            index = np.full(len(hashes), -1, dtype=np.int64)
            index[places] = np.arange(len(places))
            index = index.tolist()
            again = []
            for s in np.unique(segment[places[recurs]]).tolist():  # in the order of first places
                base = int(first[s])
                doc, text, unit = lead[s]
                for end, phrase in found.iter(tuple(numbers[base:first[s + 1]])):
                    at = (doc, text, unit + end - n + 1)
                    if met[phrase] is None:
                        met[phrase] = at
                    elif met[phrase] != at:  # not another row of the same document
                        again.append(index[base + end - n + 1])
            earlier[again] = True
        if block.goes_on:
            mine = np.flatnonzero(block.anchor[segment[places]] == block.anchor[-1])
            if len(block.anchor) and (block.anchor[0] != block.anchor[-1]):
                self.seen.clear()
            at = block.places[block.first[segment[places[mine]]]]
            at = np.column_stack([at[:, :2], at[:, 2] + places[mine] - first[segment[places[mine]]]]).tolist()
            for i, place in zip(mine.tolist(), at, strict=True):
                self.seen.setdefault((int(a[i]), int(b[i])), tuple(place))
        else:
            self.seen.clear()
        return segment[places], places - first[segment[places]], earlier


def repeated(docs: DataFrame, n: int = PHRASE_WORDS, gram: int = GRAM_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text_hash, start, stop of word ranges whose phrases all start earlier too (ranges may overlap)."""
    units = Units(words=True, window=n, gram=gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(n)
        for block in blocks(batches, block_bytes):
            segment, inside, earlier = shard.take(block)
            begin, end = runs(earlier, segment)
            if len(begin):
                lead = block.places[block.first[segment[begin]]]
                yield span_batch(lead, inside[begin], inside[end] + n)
            # Other copies of a segment have the first one before them, so all their phrases do.
            total = np.bincount(segment, minlength=len(block.anchor)) + n - 1
            copies = np.diff(block.first) - 1
            which = np.repeat(np.arange(len(copies)), copies)
            if len(which):
                where = block.places[np.setdiff1d(np.arange(len(block.places)), block.first[:-1])]
                lead = block.places[block.first[which]]
                other = (where != lead).any(axis=1)
                yield span_batch(where[other], 0, total[which][other])

    return segments(docs, units).mapInArrow(run, SPANS)


def digests(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column(1))
            starts, ends, first = spans(data, offsets, SPACED)
            gone = marked(batch.column(2), first, len(starts))
            row = rows_of(first, len(starts))
            # Kept words, each after one space, as one buffer: every word and the byte before it.
            raw, out = data.tobytes(), []
            cut = np.flatnonzero(np.bincount(row[gone], minlength=batch.num_rows))
            cut = set(cut.tolist())
            for r in range(batch.num_rows):
                if r in cut:
                    words = [raw[starts[i]:ends[i]] for i in range(first[r], first[r + 1]) if not gone[i]]
                else:
                    words = raw[offsets[r]:offsets[r + 1]].split()
                out.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(first)), pa.array(np.bincount(row[gone], minlength=batch.num_rows)), pa.array(out)],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return with_spans(docs, repeated(docs, **parameters)).mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
