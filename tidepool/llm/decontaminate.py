"""Benchmark decontamination by suffix arrays over the training documents.

Each slice of documents is a shard. Its suffix array holds the word suffixes that
can match at all (their first words stand in the benchmark; a bit table decides),
ordered by their first ten words. Every suffix of every benchmark item is searched
in it by bisection; the run of equal entries gives all its places. Hits that follow
one another in both texts are joined into longest verbatim matches. The benchmark
is the stated query set: it is sent to the tasks in blocks of about ``block_words``
words, one after another. If there are several, each block's results are written and its
broadcast is destroyed before the one after the next is built, so a larger benchmark takes
more passes over the documents, not more memory: the driver holds at most two blocks.

An item shorter than a window is one window of its own length.

Cases: a null or empty text has no words, so no hits and no windows; items that
repeat count once by item_id; a null item_id is shown as the empty string; rows that
repeat a doc_id are judged each; other columns are not read; an empty benchmark or
an empty table of documents gives no hits. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.session_tools import ready, rows_that, stage, text_input
from tidepool.llm.textops import ALNUM, LOWER, gram_hash, rows_of, slices, spans, text_bytes, word_hashes

WINDOW = 10
BLOCK_WORDS = 500_000
_BITS = 22


def words_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all rows, and each row's first word."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, first = spans(data, offsets, ALNUM)
    return word_hashes(data, starts, ends), first


def suffix_keys(words: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """The first ``depth`` words of each suffix as a byte string that sorts like them."""
    rows = words[places[:, None] + np.arange(depth)].astype(">u8")
    return np.ascontiguousarray(rows).view(f"S{8 * depth}").ravel()


def whole(first: np.ndarray, row: np.ndarray, depth: int) -> np.ndarray:
    """Places where ``depth`` words follow in the same row."""
    places = np.arange(len(row))
    return places[places + depth <= first[row + 1]]


class Queries:
    """The sorted windows of one block of benchmark items."""

    def __init__(self, ids: list[str], column, window: int):
        words, first = words_of(column)
        row, lengths = rows_of(first, len(words)), np.diff(first)
        self.ids, self.by_depth = ids, []
        for depth in sorted({min(int(n), window) for n in lengths if n}):
            places = whole(first, row, depth)
            places = places[np.minimum(lengths[row[places]], window) == depth]
            keys = suffix_keys(words, places, depth)
            order = np.argsort(keys, kind="stable")
            keys, places = keys[order], places[order]
            new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            lead = min(depth, 4)
            table = np.zeros(1 << _BITS, dtype=bool)
            table[gram_hash(words, lead)[places] >> np.uint64(64 - _BITS)] = True
            self.by_depth.append((depth, lead, np.packbits(table), keys[new], np.append(new, len(keys)), row[places], places - first[row[places]]))

    def search(self, words: np.ndarray, first: np.ndarray, row: np.ndarray) -> np.ndarray:
        """All hits as rows (document row, item, place in item, place in document, words)."""
        found = [np.empty((0, 5), dtype=np.int64)]
        for depth, lead, packed, keys, runs, item, at in self.by_depth:
            grams = gram_hash(words, lead)
            slot = (grams >> np.uint64(64 - _BITS)).astype(np.int64)
            likely = np.flatnonzero((packed[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1)
            places = likely[likely + depth <= first[row[likely] + 1]]
            if not len(places):
                continue
            array = suffix_keys(words, places, depth)
            order = np.argsort(array, kind="stable")  # the shard's suffix array
            array, places = array[order], places[order]
            low, high = np.searchsorted(array, keys, "left"), np.searchsorted(array, keys, "right")
            for q in np.flatnonzero(high > low):
                p = places[low[q]:high[q]]
                r = slice(runs[q], runs[q + 1])
                n = runs[q + 1] - runs[q]
                found.append(np.column_stack([np.repeat(row[p], n), np.tile(item[r], len(p)), np.tile(at[r], len(p)),
                                              np.repeat(p - first[row[p]], n), np.full(n * len(p), depth)]))
        return longest(np.concatenate(found))


def longest(hits: np.ndarray) -> np.ndarray:
    """Joins hits of neighbouring places on one diagonal into longest matches."""
    if not len(hits):
        return hits
    diagonal = hits[:, 3] - hits[:, 2]
    hits = hits[np.lexsort((hits[:, 3], diagonal, hits[:, 1], hits[:, 0]))]
    diagonal = hits[:, 3] - hits[:, 2]
    follows = np.zeros(len(hits), dtype=bool)
    follows[1:] = ((hits[1:, :2] == hits[:-1, :2]).all(axis=1) & (diagonal[1:] == diagonal[:-1]) & (hits[1:, 3] == hits[:-1, 3] + 1))
    begin = np.flatnonzero(~follows)
    last = np.append(begin[1:], len(hits)) - 1
    out = hits[begin].copy()
    out[:, 4] = hits[last, 3] + hits[last, 4] - out[:, 3]
    return out


MATCH = pa.struct([("item_id", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("n_words", pa.int32())])


def blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Queries]:
    """The benchmark's items in blocks of about ``block_words`` words."""
    ids, texts, size = [], [], 0
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string"))
    for r in items.where(F.col("text").isNotNull()).toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1]) // 6 + 1
        if size >= block_words:
            yield Queries(ids, pa.array(texts, pa.string()), window)
            ids, texts, size = [], [], 0
    if ids:
        yield Queries(ids, pa.array(texts, pa.string()), window)


def last_flags(items: Iterator[Queries]) -> Iterator[tuple[Queries, bool]]:
    """Each item and whether it is the last one."""
    held = next(items, None)
    while held is not None:
        after = next(items, None)
        yield held, after is None
        held = after


def searched(docs: DataFrame, sent: Broadcast | None) -> DataFrame:
    """The columns of ``docs`` but text (doc_id, text_hash), n_words and the longest verbatim matches with one block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, first = words_of(batch.column(2))
            row = rows_of(first, len(words))
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            if sent is not None:
                queries = sent.value
                for r, item, at, p, n in queries.search(words, first, row).tolist():
                    found[r].append({"item_id": queries.ids[item], "item_word": at, "doc_word": p, "n_words": n})
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(first)), pa.array(found, pa.list_(MATCH))],
                                             names=["doc_id", "text_hash", "n_words", "matches"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, n_words long, "
                                "matches array<struct<item_id string, item_word int, doc_word int, n_words int>>")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words and the longest verbatim matches of every document."""
    spark = docs.sparkSession
    ready(spark)
    docs = text_input(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    parts = []
    for queries, last in last_flags(blocks(benchmark, window, block_words)):
        sent = spark.sparkContext.broadcast(queries)
        found = searched(docs, sent)
        if last and not parts:
            return found.drop("text_hash")
        # Rows that repeat an id and its text have the same matches.
        parts.append(stage(found.where(F.size("matches") > 0).dropDuplicates(["doc_id", "text_hash"]), "decontaminate-block"))
        sent.destroy()
    every = searched(docs, None)
    if not parts:
        return every.drop("text_hash")
    found = reduce(DataFrame.unionByName, parts).groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(
        F.flatten(F.collect_list("matches")).alias("found"))
    every = every.join(found, every["doc_id"].eqNullSafe(found["d"]) & (every["text_hash"] == found["h"]), "left")
    return every.select("doc_id", "n_words", F.coalesce("found", "matches").alias("matches"))


def covered(matches: F.Column) -> F.Column:
    """How many words lie in any of the matches: sorted by place, each adds what lies beyond the ones before."""
    ordered = F.array_sort(F.transform(matches, lambda m: F.struct(m["doc_word"].alias("a"), (m["doc_word"] + m["n_words"]).alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    return F.aggregate(ordered, start, lambda s, m: F.struct(
        (s["n"] + F.greatest(F.lit(0), m["b"] - F.greatest(m["a"], s["to"]))).cast("long").alias("n"),
        F.greatest(s["to"], m["b"]).alias("to")), lambda s: s["n"])


def judge(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """One row per document: how much of it stands in the benchmark, and in which items."""
    items = F.array_sort(F.array_distinct(F.col("matches.item_id")))
    return matches(docs, benchmark, **parameters).select(
        "doc_id", "n_words", covered(F.col("matches")).alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (F.size("matches") > 0).alias("contaminated"))




def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of the documents without any benchmark passage, with all their columns."""
    ready(docs.sparkSession)
    for queries, last in last_flags(blocks(benchmark, window, block_words)):
        sent = docs.sparkSession.sparkContext.broadcast(queries)
        docs = rows_that(docs, without(sent))
        if not last:
            docs = stage(docs, "decontaminate-left")
            sent.destroy()
    return docs


def without(sent: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, pa.Array]]]:
    """Marks the rows without any passage of one block."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
        for batch in slices(batches, "text"):
            words, first = words_of(batch.column(batch.schema.get_field_index("text")))
            kept = np.ones(batch.num_rows, dtype=bool)
            kept[sent.value.search(words, first, rows_of(first, len(words)))[:, 0]] = False
            yield batch, pa.array(kept)

    return keep
