"""Near-duplicate removal by bottom-k sketches.

One hash function orders all shingles. A document's sketch is the k least hashes of its
shingle set, so the k least values of two sketches together are a uniform sample of the
union, and the share of that sample which both sketches hold estimates the Jaccard
similarity. By Chernoff's bound, similar documents share at least ``least_shared`` of it,
but for a chance of 10**-12 a pair.

1. Inverted lists: each retained value names the documents that retained it. Of k values
   at least c are shared by similar documents, so if each document keeps all but its c - 1
   most frequent ones (in one order for all), similar ones still meet in a list; values of
   common passages are left out by that. Sets of lists with one lead are put together in cells.
2. In a cell, overlaps of sketches and the estimate from the union sketch filter the pairs.
3. The rest is verified on the full sets; links become components (see set_groups.py).

Equal sets are one class and are compared once. Lists and groups have no caps; large groups
are split into cells of bounded size.

Cases: a null or empty text has the empty set, is linked with nothing and is its own
component; a text of fewer words than a shingle is one shingle; rows that repeat a doc_id
or have none are judged each; a component's id is the least that is not null (null if there is
none; such a document is kept, as no other stands for it); other columns are not read; an empty
table gives an empty result. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.jaccard_join import components, set_ids, token_sets, with_components
from tidepool.llm.session_tools import ready, stage, text_input
from tidepool.llm.set_groups import least_shared, linked, shared_counts, shared_of, token_table
from tidepool.llm.textops import signed, slices

SHINGLE = 4
PERCENT = 80
SKETCH = 96


def needed(sizes: np.ndarray, k: int, percent: int) -> np.ndarray:
    """How many of the rarest values of a document's sketch hold one in common with each similar document."""
    return np.minimum(sizes, k) - shared_of(sizes, k, percent) + 1


def sketches(docs: DataFrame, shingle: int, k: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, id (of the set, null if empty), need, sketch of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            tokens, row, sizes = token_sets(batch.column(1), shingle)
            first = np.cumsum(sizes) - sizes
            low = np.arange(len(tokens)) - first[row] < k  # tokens of a row are sorted
            kept = np.minimum(sizes, k)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)]), pa.int32()), pa.array(signed(tokens[low])))
            ids = pa.array(signed(set_ids(tokens, sizes)), mask=sizes == 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes), ids, pa.array(needed(sizes, k, percent), pa.int32()), lists],
                names=["doc_id", "text_hash", "n_shingles", "id", "need", "sketch"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        run, "doc_id long, text_hash long, n_shingles long, id long, need int, sketch array<long>")


def classes(docs: DataFrame) -> DataFrame:
    """id, rep (least doc_id that is not null), rep_hash, size, need, sketch of every distinct set."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    sets = docs.where("id is not null").groupBy("id").agg(first, F.max("n_shingles").alias("size"), F.max("need").alias("need"), F.max("sketch").alias("sketch"))
    return sets.select("id", F.col("first.doc_id").alias("rep"), F.col("first.text_hash").alias("rep_hash"), "size", "need", "sketch")


def inverted(sets: DataFrame) -> DataFrame:
    """key, id: the inverted lists of the values that each set keeps."""
    values = sets.select("id", "need", F.explode("sketch").alias("value"))
    often = stage(values.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sketch-often")
    shared = values.join(often, "value")
    size = sets.select("id", F.size("sketch").alias("retained"))
    mine = Window.partitionBy("id")
    shared = shared.join(size, "id").withColumns({
        "alone": F.col("retained") - F.count(F.lit(1)).over(mine),  # values that no other document retained
        "rank": F.row_number().over(mine.orderBy("n", "value"))})
    return stage(shared.where("rank + alone <= need").select(F.col("value").alias("key"), "id"), "sketch-lists")


def estimate(k: int, percent: int):
    """The filter on pairs: enough of the union sketch's values are in both sketches."""
    least = least_shared(k, percent)

    def may(xs: list[np.ndarray], ys: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = [t[:k] for t in xs], [t[:k] for t in ys]
        small = (np.array([len(t) for t in xs]) <= k)[i] & (np.array([len(t) for t in ys]) <= k)[j]
        keep = (shared_counts(a, b)[i, j] >= least) | small  # of sets retained whole the exact check costs no more
        left, right = padded(a, k), padded(b, k)
        for at in range(0, len(i), 8192):
            p = at + np.flatnonzero(keep[at:at + 8192] & ~small[at:at + 8192])
            both = np.sort(np.concatenate([left[i[p]], right[j[p]]], axis=1), axis=1)
            again = np.zeros(both.shape, dtype=bool)
            again[:, 1:] = both[:, 1:] == both[:, :-1]
            again &= both != EMPTY
            rank = np.cumsum(~again, axis=1)  # of distinct values
            keep[p] = (again & (rank <= k)).sum(axis=1) >= least
        return keep

    return may


#: Fills up short sketches; sorts last.
EMPTY = np.uint64((1 << 64) - 1)


def padded(sketches: list[np.ndarray], k: int) -> np.ndarray:
    out = np.full((len(sketches), k), EMPTY, dtype=np.uint64)
    for row, sketch in zip(out, sketches, strict=True):
        row[:len(sketch)] = sketch
    return out


def components_of(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, k: int = SKETCH, **cells) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id of every document."""
    ready(docs.sparkSession)
    docs = text_input(docs, "doc_id", "text")
    known = stage(sketches(docs, shingle, k, percent), "sketches")
    sets = stage(classes(known), "sketch-classes")
    lists = inverted(sets)
    tokens = token_table(docs, sets, lists.select("id").distinct(), token_sets, set_ids, shingle)
    roots = linked(tokens, sets, lists, percent, components, may=estimate(k, percent), **cells)
    return with_components(known, sets, roots)


def judge(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (whether it gives its component the id) of every document."""
    out = components_of(docs, **parameters)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
