"""Spelling variants: groups of words one edit apart, found by scanning sorted word lists.

1. Words are counted over whole texts, map-side first. The vocabulary is every word
   that is long and frequent enough.
2. Two words one edit apart, the shorter of n code points, share their first n // 2 code
   points or their last n - n // 2, whichever side the edit is not on. Each word joins the
   groups of its own length and of the length below, by its start and, reversed, by its end.
3. A group is a sorted list. A query word walks it through an edit matrix of which only
   the band of three cells around the diagonal can hold a distance of one. Words that are
   adjacent in the list share a prefix (their LCP), and the matrix rows of that prefix
   are computed once for the whole range; a range whose row has no cell below two is
   skipped. All queries of a block walk at once, one depth after another.
4. A word's form is its most frequent near word; forms lead to a root by pointer jumping.

A group of more than ``CELL_WORDS`` words is cut into a grid: its words into rows (as
queries) and columns (as the list), so a start that a third of all words share is spread
over many tasks of bounded size, and every pair still meets in one cell.

Cases: a null or empty text has no words; a null doc_id counts as the text ``None`` in the
check sum; rows that repeat a doc_id are counted each; texts of any length are read whole; ties
between near words go to the smallest word; other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.session_tools import ready, stage, text_input

MIN_LENGTH = 6
MIN_COUNT = 5
#: One occurrence in so many loses a code point.
SLIP = 199
#: A form is so many times as frequent as its variant.
RATIO = 5
CELL_WORDS = 20_000
#: Distinct words that a task holds before it passes its counts on, and rows that walk at once.
HELD_WORDS = 200_000
BLOCK_ROWS = 40_000


def counted(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n of the vocabulary."""
    ready(docs.sparkSession)
    runs = re.compile(f"[a-zÀ-ÿ]{{{min_length},}}")
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def rows(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                # Bytes lower-case A-Z only.
                text = (text.as_py() or "").encode().lower().decode()
                seed = crc32(f"{doc}:".encode())
                for word, n in Counter(runs.findall(text)).items():
                    h = crc32(word.encode(), seed)
                    if h % SLIP == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < min_length:
                            continue
                    held[word] += n
                if len(held) >= HELD_WORDS:
                    yield rows(held)
                    held.clear()
        yield rows(held)

    words = text_input(docs, "doc_id", "text").mapInArrow(run, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def members(vocabulary: DataFrame) -> DataFrame:
    """word, side, size, part: each word in its groups, by start and end, of its own length and of the one below."""
    size = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("size")
    by_size = vocabulary.select("word", F.reverse("word").alias("back"), size)
    half = F.col("size").bitwiseAND(-2) / 2  # size // 2
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("text"), half.cast("int").alias("shared")),
                              F.struct(F.lit(1).alias("side"), F.col("back").alias("text"), (F.col("size") - half).cast("int").alias("shared"))))
    split = by_size.select("size", sides.alias("s")).select("size", "s.*")
    return split.select("side", "size", F.expr("substring(text, 1, shared)").alias("part"), F.expr("substring(text, shared + 1)").alias("rest"))


def cells(vocabulary: DataFrame, cell_words: int) -> DataFrame:
    """side, size, part, row, col, query, rest: every group's list and its queries, a large group's in a grid."""
    group = ["side", "size", "part"]
    rows = members(vocabulary)
    large = rows.groupBy(group).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > cell_words)
    large = stage(large.select(*group, F.ceil(F.col("m") / cell_words).cast("int").alias("k")), "spelling-large")
    rows = rows.join(large, group, "left").withColumn("k", F.coalesce("k", F.lit(1)))
    own = F.pmod(F.xxhash64("rest"), "k").cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    is_query = (F.length("part") + F.length("rest")) == F.col("size")
    listed = rows.select(*group, own.alias("col"), every.alias("row"), F.lit(False).alias("query"), "rest")
    asked = rows.where(is_query).select(*group, every.alias("col"), own.alias("row"), F.lit(True).alias("query"), "rest")
    return listed.unionByName(asked)


def walk(lists: list[str], list_group: np.ndarray, queries: list[str], query_group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, list place) one edit apart or equal; lists are sorted by group, then text."""
    if not lists or not queries:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    words, asked = codes(lists, 0), codes(queries, 1)
    lengths = np.array([len(q) for q in queries])
    # LCP of each word with the one before it in the list; a group's first word shares nothing.
    differ = words[1:] != words[:-1]
    lcp = np.concatenate([[-1], np.where(list_group[1:] != list_group[:-1], -1, np.where(differ.any(axis=1), differ.argmax(axis=1), words.shape[1]))])
    low = np.searchsorted(list_group, query_group)
    high = np.searchsorted(list_group, query_group, side="right")
    q = np.flatnonzero(low < high)
    low, high = low[q], high[q]
    # The band: distances of the range's shared prefix to the query's first depth - 1, depth and depth + 1 code points.
    left, middle, right = np.full(len(q), 2, np.int8), np.zeros(len(q), np.int8), np.ones(len(q), np.int8)
    out_q, out_w = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for depth in range(words.shape[1]):
        if not len(q):
            break
        # Each range falls into one for every next code point.
        starts = np.flatnonzero(lcp <= depth)
        a, b = np.searchsorted(starts, low), np.searchsorted(starts, high)
        times = b - a
        which = np.repeat(np.arange(len(q)), times)
        child = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + a[which]
        begin = starts[child]
        end = np.append(starts[1:], len(lists))[child]
        q, left, middle, right = q[which], left[which], middle[which], right[which]
        c, n = words[begin, depth], lengths[q]
        # A word that ends here: its distance is in the cell of the query's whole length.
        done = c == 0
        gap = n - depth
        distance = np.where(gap == 0, middle, np.where(gap == -1, left, np.where(gap == 1, right, 2)))
        hit = done & (distance <= 1)
        out_q.append(q[hit])
        out_w.append(begin[hit])
        # The next row of the band; out-of-band cells hold two or more.
        wide = asked.shape[1] - 1
        before, here, after = (asked[q, min(max(i, 0), wide)] if i >= 0 else np.ones(len(q), np.int32) for i in (depth - 1, depth, depth + 1))
        new_left = np.minimum(middle + 1, left + (c != before))
        new_middle = np.minimum(np.minimum(right + 1, middle + (c != here)), new_left + 1)
        new_right = np.minimum(right + (c != after), new_middle + 1)
        new_middle[depth + 1 > n] = 2
        new_right[depth + 2 > n] = 2
        new_left[depth > n] = 2
        alive = ~done & (np.minimum(np.minimum(new_left, new_middle), new_right) <= 1)
        q, low, high = q[alive], begin[alive], end[alive]
        left, middle, right = (np.minimum(x, 2)[alive] for x in (new_left, new_middle, new_right))
    return np.concatenate(out_q), np.concatenate(out_w)


def codes(words: list[str], end: int) -> np.ndarray:
    """Code points of each word, then ``end`` (which no word holds) at least twice."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    out = np.full((len(words), int(lengths.max(initial=0)) + 2), end, dtype=np.int32)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.int32)
    row = np.repeat(np.arange(len(words)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def near(vocabulary: DataFrame, cell_words: int = CELL_WORDS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """a, b: every two words one edit apart, once."""
    ready(vocabulary.sparkSession)
    key = ["side", "size", "part", "col", "row"]
    # Of a cell, the sorted list comes first, then the queries.
    ordered = cells(vocabulary, cell_words).repartition(*key).sortWithinPartitions(*key, "query", "rest")

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        cell = cell_starts(rows)
        number = np.cumsum(cell) - 1
        is_query = np.asarray(rows["query"])
        rest = rows["rest"].to_pylist()
        at_list, at_query = np.flatnonzero(~is_query), np.flatnonzero(is_query)
        q, w = walk([rest[i] for i in at_list], number[at_list], [rest[i] for i in at_query], number[at_query])
        side, part, size = (rows[c].to_pylist() for c in ("side", "part", "size"))
        a, b = [], []
        for i, j in zip(at_query[q].tolist(), at_list[w].tolist(), strict=True):
            x, y = rest[i], rest[j]
            if len(x) == len(y) and x >= y:
                continue  # the word itself, or a pair met from the other word
            if side[i]:
                x, y = (part[i] + x)[::-1], (part[i] + y)[::-1]
                if x[:size[i] // 2] == y[:size[i] // 2]:
                    continue  # met in a group by start
            else:
                x, y = part[i] + x, part[i] + y
            a.append(x)
            b.append(y)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])

    def cell_starts(rows: pa.Table) -> np.ndarray:
        new = np.zeros(rows.num_rows, dtype=bool)
        new[:1] = True
        for c in key:
            x = rows[c].combine_chunks()
            x = x.dictionary_encode().indices if pa.types.is_string(x.type) else x
            x = np.asarray(x)
            new[1:] |= x[1:] != x[:-1]
        return new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            if held.num_rows < block_rows:
                continue
            # Whole cells go; the last one may go on. A cell has a bounded list and a bounded number of queries.
            cut = int(np.flatnonzero(cell_starts(held))[-1])
            if cut:
                yield pairs(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield pairs(held)

    return ordered.mapInArrow(run, "a string, b string")


def roots(forms: DataFrame) -> DataFrame:
    """word, root for words with a form: pointers are doubled until none moves; a form is RATIO times as frequent, so there are few steps."""
    at = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stage(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    vocabulary = stage(counted(docs), "spelling-vocabulary")
    pairs = stage(near(vocabulary, cell_words), "spelling-pairs")
    links = pairs.union(pairs.select("b", "a")).toDF("word", "other")
    count = vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    # The largest count, then the smallest word.
    best = links.join(count, "other").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))).alias("best"))
    frequent = -F.col("best.less") >= RATIO * F.col("n")
    judged = vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("best.other")).alias("form"),
        F.when(frequent, -F.col("best.less")).alias("form_n"))
    judged = stage(judged, "spelling-forms")
    ends = roots(judged.where("form is not null"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
