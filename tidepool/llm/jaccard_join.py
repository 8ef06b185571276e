"""N-gram Jaccard join by universe partition and the pigeonhole principle.

A document's set is its distinct word shingles. Sets are put into bands by size; a pair
above the threshold is always together in one band's group, and its symmetric difference
is at most the group's H. A group hashes the token universe into segments. Each segment
has an allocation: 1 indexes the segment's subset, 2 also its one-deletion neighbourhood,
so a match means a difference of at most allocation - 1 there. Allocations add up to H + 1, so by
the pigeonhole principle some segment of every such pair matches. How many segments get 1
and how many 2 is chosen for each group by cost: index rows against the candidates
expected from the number of documents in the group.

A group without neighbourhoods gets twice as many segments as it needs. Then a pair
agrees in that many more, and each document can leave out its most frequent signatures
(allocation 0): the rarest ones, in one order for all and one more than the largest
difference that its size allows, still hold a common one. The cost model prices this path, too.

Equal sets are one class and take part once. Before they are indexed, sets of whose ``SKETCH``
least hashes too few are in any other set leave: they have no similar one (but for a chance of
10**-12 a pair), and most documents are like that. Sets that share a kept signature are compared
exactly, in cells of bounded size (see set_groups.py); no link between components is lost.

Cases: a null or empty text has the empty set, is linked with nothing and is its own
component; a text of fewer words than a shingle is one shingle; rows that repeat a doc_id
or have none are judged each; a component's id is the least that is not
null (null if there is none); other columns are not read; an empty table gives an empty
result. Texts of any length are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.session_tools import ready, stage, text_input
from tidepool.llm.set_groups import linked, shared_of, sketched, token_table
from tidepool.llm.textops import LOWER, SLICE_BYTES, SPACED, gram_hash, mix, prefix_sums, range_hash, rows_of, signed, slices, spans, text_bytes, word_hashes

SHINGLE = 3
PERCENT = 90
#: Least hashes that tell the sets that can have a similar one.
SKETCH = 48
#: A band is as wide as this many steps of the threshold.
BAND_STEPS = 3
#: For cost estimates only: the chance that two documents agree in a token, and what a candidate costs in index rows.
AGREE = 0.01
CANDIDATE_COST = 20.0


class Bands:
    """Size bands and each group's segments: edges[b] is the least size of band b."""

    def __init__(self, percent: int, counts: dict[int, int] | None = None):
        self.percent, self.edges = percent, [1]
        while self.edges[-1] < 1 << 40:
            e = self.edges[-1]
            for _ in range(BAND_STEPS):
                e = self.partner(e) + 1
            self.edges.append(e)
        counts = counts or {}
        self.cap = np.array([self.partner(e - 1) for e in self.edges[1:]])
        plans = []
        for b, (low, high) in enumerate(zip(self.edges, self.edges[1:], strict=False)):
            most = self.difference(high - 1, self.partner(high - 1))
            n = counts.get(b, 0) + counts.get(b + 1, 0)
            plans.append(allocation(most, (low + high) / 2, n))
        self.exact, self.near, self.spare = (np.array(x) for x in zip(*plans, strict=True))
        self.group_bits = len(self.edges).bit_length()

    def budgets(self) -> tuple[list[int], list[int]]:
        """Of each group: its segments, and how many of a document's signatures are to be kept whatever its size."""
        return (self.exact + self.near).tolist(), np.where(self.near > 0, 1 << 30, 0).tolist()

    def needed(self, sizes: np.ndarray) -> np.ndarray:
        """How many of a document's rarest signatures hold one in common with each similar document."""
        return self.difference(sizes, self.partner(sizes)) + 1

    def partner(self, size: int) -> int:
        """The largest size that can be similar to this one."""
        return size * 100 // self.percent

    def difference(self, a: int, b: int) -> int:
        """The largest symmetric difference of similar sets of these sizes."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, sizes, side="right") - 1


def allocation(most: int, size: float, n: int) -> tuple[int, int, int]:
    """(segments with allocation 1, with allocation 2, spare ones among the first) of least cost; none if only equal sets are similar.

    With spare segments, the allocations 0 and 1 are left to each document: it keeps its rarest signatures.
    """
    if most == 0:
        return 0, 0, 0

    def candidates(meet: float) -> float:
        return CANDIDATE_COST * n / 2 * meet

    def neighbourhoods(near: int) -> float:
        exact = most + 1 - 2 * near
        t = size / max(exact + near, 1)
        empty = math.exp(-2 * t)
        meet = exact * (empty + AGREE ** t) + near * (empty * (1 + 2 * t) + (1 + 2 * t) * AGREE ** max(t - 1, 0))
        return exact + near * (1 + t) + candidates(meet)

    # All signatures are counted, half of them kept: the fuller half, with about twice the median's tokens.
    rarest = 2 * most + 1 + (most + 1) + candidates((most + 1) * AGREE ** (2 * size / (2 * most + 1)))
    # Costs are smooth in the number of neighbourhoods; a grid of at most 33 values is enough.
    top = (most + 1) // 2
    near = min({round(top * i / 32) for i in range(33)} - {0}, key=lambda x: (neighbourhoods(x), x), default=0)
    if near and neighbourhoods(near) < rarest:
        return max(most + 1 - 2 * near, 0), near, 0
    return 2 * most + 1, 0, most


def token_sets(column, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct tokens of all rows, their rows, and the set sizes."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, first = spans(data, offsets, SPACED)
    words, rows = word_hashes(data, starts, ends), len(offsets) - 1
    row = rows_of(first, len(words))
    grams = gram_hash(words, shingle)
    at = np.flatnonzero(row[:len(grams)] == row[shingle - 1:]) if len(grams) else np.empty(0, np.int64)
    short = np.flatnonzero((np.diff(first) < shingle) & (np.diff(first) > 0))
    whole = range_hash(prefix_sums(words), first[short], first[short + 1])
    tokens, row = np.concatenate([grams[at], whole]), np.concatenate([row[at], short])
    order = np.lexsort((tokens, row))
    tokens, row = tokens[order], row[order]
    new = np.ones(len(tokens), dtype=bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (row[1:] != row[:-1])
    tokens, row = tokens[new], row[new]
    return tokens, row, np.bincount(row, minlength=rows)


def set_ids(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit id of each row's set; equal sets have equal ids."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(tokens ^ np.uint64(0xC2B2AE3D27D4EB4F)), dtype=np.uint64)])
    end = np.cumsum(sizes)
    return mix(sums[end] - sums[end - sizes] + sizes.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def tagged(x: np.ndarray, group: np.ndarray, bits: int) -> np.ndarray:
    """A signature with its group in the last bits."""
    return (mix(x) << np.uint64(bits)) | group.astype(np.uint64)


def signatures(tokens: np.ndarray, row: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of every indexed subset and neighbourhood."""
    out_row, out = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    weight = mix(tokens ^ np.uint64(0x94D049BB133111EB))
    own = bands.of(sizes)
    for group in (own, own - 1):  # as a member of its band, and as a partner of smaller sets
        use = (sizes > 0) & (group >= 0)
        g = np.maximum(group, 0)
        use &= sizes <= bands.cap[g]
        exact, near = bands.exact[g] * use, bands.near[g] * use
        m = exact + near
        start = np.concatenate([[0], np.cumsum(m)])
        if not start[-1]:
            continue
        mine = np.flatnonzero(m[row] > 0)
        r = row[mine]
        segment = (mix(tokens[mine] + g[r].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)) % m[r].astype(np.uint64)).astype(np.int64)
        slot = start[r] + segment
        sums = np.zeros(start[-1], dtype=np.uint64)
        np.add.at(sums, slot, weight[mine])
        slot_row = np.repeat(np.arange(len(sizes)), m)
        label = mix((g[slot_row].astype(np.uint64) << np.uint64(40)) + (np.arange(start[-1]) - start[slot_row]).astype(np.uint64) + np.uint64(1))
        out_row.append(slot_row)
        out.append(tagged(sums + label, g[slot_row], bands.group_bits))
        wide = segment >= exact[r]
        if wide.any():
            out_row.append(r[wide])
            out.append(tagged(sums[slot[wide]] - weight[mine][wide] + label[slot[wide]], g[r[wide]], bands.group_bits))
    return np.concatenate(out_row), np.concatenate(out)


def band_counts(sets: DataFrame, bands: Bands) -> dict[int, int]:
    """Sets (size) by band, for the cost model only: a row for each band that occurs."""
    edges = F.array(*[F.lit(e) for e in bands.edges])
    band = F.size(F.filter(edges, lambda e: e <= F.col("size"))) - 1
    return {r.b: r["count"] for r in sets.groupBy(band.alias("b")).count().collect()}


def members(docs: DataFrame, percent: int, shingle: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, id of every document's set (null where empty), least and sketch (its least hashes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            tokens, row, sizes = token_sets(batch.column(1), shingle)
            low = np.arange(len(tokens)) - (np.cumsum(sizes) - sizes)[row] < SKETCH  # tokens of a row are sorted
            at = np.concatenate([[0], np.cumsum(np.minimum(sizes, SKETCH))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes), pa.array(signed(set_ids(tokens, sizes)), mask=sizes == 0),
                 pa.array(shared_of(sizes, SKETCH, percent), pa.int32()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(signed(tokens[low])))],
                names=["doc_id", "text_hash", "n_shingles", "id", "least", "sketch"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        run, "doc_id long, text_hash long, n_shingles long, id long, least int, sketch array<long>")


def classes(known: DataFrame) -> DataFrame:
    """id, rep (least doc_id that is not null), rep_hash, size, least, sketch of every distinct set."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    sets = known.where("id is not null").groupBy("id").agg(
        first, F.max("n_shingles").alias("size"), F.max("least").alias("least"), F.max("sketch").alias("sketch"))
    return sets.select("id", F.col("first.doc_id").alias("rep"), F.col("first.text_hash").alias("rep_hash"), "size", "least", "sketch")


def index_rows(tokens: DataFrame, bands: Bands) -> DataFrame:
    """id, need, sig: the signatures of every set of ``tokens`` (id, tokens)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids = np.asarray(batch.column(0))
            sets = [np.frombuffer(t.as_buffer(), dtype=np.uint64) for t in batch.column(1)]
            sizes = np.array([len(t) for t in sets])
            row, sig = signatures(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), sizes, bands)
            need = bands.needed(sizes)
            for i in range(0, len(sig), 1 << 16):
                r = row[i:i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(need[r], pa.int32()), pa.array(signed(sig[i:i + (1 << 16)]))],
                                                 names=["id", "need", "sig"])

    def pieces(batches):
        for batch in batches:
            step = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1))
            for i in range(0, batch.num_rows, step):
                yield batch.slice(i, step)

    return tokens.mapInArrow(run, "id long, need int, sig long")


def indexed(rows: DataFrame, bands: Bands) -> DataFrame:
    """key, id: the lists of the signatures that each set keeps."""
    # Signatures that several sets share, with how often each stands. A table of its own, not a window over sig,
    # so that the join can broadcast it or split a hot signature.
    often = stage(rows.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "jaccard-often")
    g = F.col("sig").bitwiseAND(F.lit((1 << bands.group_bits) - 1)).cast("int").alias("g")
    counted = rows.join(often, "sig").select("id", "need", "sig", "n", g)
    segments, kept = (F.get(F.array(*map(F.lit, x)), F.col("g")) for x in bands.budgets())
    mine = Window.partitionBy("id", "g")
    alone = segments - F.count(F.lit(1)).over(mine)  # signatures that no other set has
    rank = F.row_number().over(mine.orderBy("n", "sig"))
    rare = counted.withColumns({"alone": alone, "rank": rank})
    return stage(rare.where(F.col("rank") + F.col("alone") <= F.greatest("need", kept)).select(F.col("sig").alias("key"), "id"), "jaccard-lists")


def components(links: DataFrame) -> DataFrame:
    """id, root for every end of a link: large-star and small-star steps until nothing changes."""
    edges = stage(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        # Large star: a node's larger neighbours move to its least neighbour.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours move to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))).distinct()
        edges = stage(small, "links")
        # Node pairs fit in an order-free sum; it stands still when the edges do.
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        state = now


def join(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, bands: Bands | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return named(docs, percent, shingle, bands).drop("text_hash", "root")


def named(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, bands: Bands | None = None) -> DataFrame:
    """doc_id, text_hash (xxhash64), n_shingles, component_id, root (a component's own id, null without a set) of every document."""
    ready(docs.sparkSession)
    docs = text_input(docs, "doc_id", "text")
    known = stage(members(docs, percent, shingle), "jaccard-members")
    sets = stage(classes(known), "jaccard-classes")
    some = stage(sketched(sets), "jaccard-some")
    tokens = token_table(docs, sets, some, token_sets, set_ids, shingle)
    bands = bands or Bands(percent, band_counts(sets.join(some, "id", "left_semi"), Bands(percent)))
    roots = linked(tokens, sets, indexed(index_rows(tokens, bands), bands), percent, components)
    return with_components(known, sets, roots)


def with_components(known: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, root: the least doc_id of the component of a document's set, or its own without a set."""
    named = sets.select("id", "rep").join(roots, "id", "left").select("id", "rep", F.coalesce("root", "id").alias("root"))
    named = stage(named, "set-roots")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "root").select("id", "component_id", "root")
    out = known.select("doc_id", "text_hash", "n_shingles", "id").join(named, "id", "left")
    own = F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return out.select("doc_id", "text_hash", "n_shingles", own, "root")


def keep_one(docs: DataFrame, percent: int, shingle: int) -> DataFrame:
    """One row of each component, with all its columns: the one with the least doc_id (null last), then the least text hash.

    Rows without any word are no copies of each other and stay. Of rows that repeat an id and its text, any one stays.
    """
    groups = stage(named(docs, percent, shingle), "components")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    chosen = groups.where("root is not null").groupBy("root").agg(first).select(F.col("first.doc_id").alias("_kept"), F.col("first.text_hash").alias("_hash"))
    rows = groups.groupBy(F.col("doc_id").alias("_kept"), F.col("text_hash").alias("_hash")).agg(
        F.count(F.lit(1)).alias("_times"), F.max("root").alias("_root"))
    chosen = chosen.join(rows, chosen["_kept"].eqNullSafe(rows["_kept"]) & (chosen["_hash"] == rows["_hash"])).select(chosen["*"], "_times")
    # Rows without a set are all kept, each as often as it stands.
    chosen = stage(chosen.union(rows.where("_root is null").select("_kept", "_hash", F.lit(1).alias("_times"))), "chosen-rows")
    kept = docs.join(chosen, docs["doc_id"].cast("long").eqNullSafe(chosen["_kept"]) & (F.xxhash64(docs["text"].cast("string")) == chosen["_hash"]))
    names = [F.col(f"`{c}`") for c in docs.columns]
    # Only rows that repeat an id and its text need a look at their texts, which would move all texts once more.
    once, more = kept.where("_times = 1").select(names), kept.where("_times > 1").select(names)
    return once.unionByName(more.dropDuplicates(["doc_id", "text"]))
