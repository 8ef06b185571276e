"""Exact similarity inside candidate lists, shared by the operators that join shingle sets.

A list is a key and the sets that an index has under it: whatever the index, two similar
sets must share a key. Sets are compared in cells, each with a bounded number of sets and tokens:
a cell compares its rows with its columns exactly, as products of 0/1 matrices over
the tokens that several of its sets hold, and gives back a spanning forest of the links it
found, never all pairs.

1. Every list is led by its least set. Each set is first put with the lead that it shares most
   keys with; such a group is one cell, or, if it is large, its lead against blocks of the rest.
   The links give a first set of components, which take up most near copies.
   A cell is worked through in blocks of bounded size; sets that one block has joined are not compared in the next.
2. Only lists that still hold several components matter then. Sets that share such a list's lead
   are a group again: one cell, or, if it is large, a grid of those outside the group's largest
   component against all of it. Two sets of one component need no further link, so no link
   between components is lost.

``sketched`` drops beforehand the sets that cannot have a similar one: of the k least hashes of
a set (a uniform sample), similar sets share at least ``least_shared`` but for a chance of
10**-12 a pair (Chernoff), so a set of whose k fewer are in any other set is alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.session_tools import stage
from tidepool.llm.textops import signed, slices

#: A large group's sets go to as many cells as it has blocks of that size: the larger, the fewer copies are made.
CELL_SETS = 2048
CELL_TOKENS = 1 << 20
#: Within a cell, so many sets are compared with so many at once.
BLOCK_SETS = 256
MISS = 1e-12
#: Columns of one 0/1 matrix.
CHUNK = 8192

#: Of sorted token lists: which (row, column) pairs are to be compared exactly.
Filter = Callable[[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray], np.ndarray]


def token_table(docs: DataFrame, sets: DataFrame, ids: DataFrame, token_sets, set_ids, shingle: int) -> DataFrame:
    """id, tokens (their sorted hashes as bytes), one row for each of ``ids``.

    ``docs``: doc_id, text. ``sets``: id, rep, rep_hash: a document with that set and the hash of its text.
    """
    needed = ids.join(sets.select("id", "rep", "rep_hash"), "id")
    found = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash")).join(
        needed, F.col("_hash").eqNullSafe(F.col("rep_hash")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            tokens, _, sizes = token_sets(batch.column(1), shingle)
            raw, end = tokens.tobytes(), np.cumsum(sizes) * 8
            keep = pa.array(signed(set_ids(tokens, sizes)) == np.asarray(batch.column(0)))  # not a text of like hash
            data = [raw[e - 8 * n:e] for e, n in zip(end.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), pa.array(data, pa.binary()).filter(keep)], names=["id", "tokens"])

    # Rows that repeat a document's id and text give the same tokens.
    return stage(found.mapInArrow(run, "id long, tokens binary").groupBy("id").agg(F.max("tokens").alias("tokens")), "set-tokens")


def whole_cells(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Rows sorted by ``key``, one table for each value of it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([np.asarray(batch[k]) for k in key], axis=1)
        new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        for i, j in zip(new.tolist(), [*new[1:].tolist(), batch.num_rows], strict=True):
            now = tuple(keys[i].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def shared_counts(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many tokens each x has in common with each y."""
    nx, ny = len(xs), len(ys)
    flat = np.concatenate([*xs, *ys])
    owner = np.repeat(np.arange(nx + ny), [len(t) for t in (*xs, *ys)])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    # Only tokens of some x and some y matter.
    number = int(column[-1]) + 1 if len(column) else 0
    both = (np.bincount(column, owner < nx, number) > 0) & (np.bincount(column, owner >= nx, number) > 0)
    place = np.cumsum(both) - 1
    use = both[column]
    column, owner = place[column[use]], owner[use]
    out = np.zeros((nx, ny), dtype=np.float32)
    for low in range(0, int(both.sum()), CHUNK):
        a, b = np.searchsorted(column, [low, low + CHUNK])
        width = min(CHUNK, int(both.sum()) - low)
        part = np.zeros((nx + ny, width), dtype=np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        out += part[:nx] @ part[nx:].T
    return out


def forest(x: np.ndarray, y: np.ndarray, n: int) -> list[int]:
    """Which of the links (x[i], y[i]) between n nodes join two trees, taken in order."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    kept = []
    for i, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        a, b = find(a), find(b)
        if a != b:
            root[b] = a
            kept.append(i)
    return kept


def joined(tree: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The tree of each node once the trees x[i] and y[i] are one; trees are numbers below len(tree)."""
    to = np.arange(len(tree))
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        a, b = to[a], to[b]
        if a != b:
            to[to == max(a, b)] = min(a, b)
    return to[tree]


def compared(cells: DataFrame, tokens: DataFrame, percent: int, may: Filter | None) -> DataFrame:
    """a, b: a forest of the links of each cell. ``cells``: lead, r, c, id, root, x, y (whether it is a row, a column)."""
    key, step = ["lead", "r", "c"], BLOCK_SETS
    rows = cells.join(tokens, "id").repartition(*key).sortWithinPartitions(*key)

    def block(sets: list[np.ndarray], size: np.ndarray, roots: np.ndarray, both: np.ndarray, at_x: np.ndarray, at_y: np.ndarray):
        """The links between some rows and some columns that are in different trees."""
        # Other components, similar sizes, and each pair from one side where both are rows and columns.
        low, high = np.minimum.outer(size[at_x], size[at_y]), np.maximum.outer(size[at_x], size[at_y])
        open_ = (roots[at_x][:, None] != roots[at_y]) & (100 * low >= percent * high)
        open_ &= ~(both[at_x][:, None] & both[at_y] & (at_x[:, None] >= at_y))
        i, j = np.nonzero(open_)
        if may is not None and len(i):
            keep = may([sets[k] for k in at_x], [sets[k] for k in at_y], i, j)
            i, j = i[keep], j[keep]
        if not len(i):
            return at_x[:0], at_y[:0]
        rx, ix = np.unique(i, return_inverse=True)
        ry, iy = np.unique(j, return_inverse=True)
        x, y = at_x[rx], at_y[ry]
        common = shared_counts([sets[k] for k in x], [sets[k] for k in y])[ix, iy].astype(np.int64)
        x, y = x[ix], y[iy]
        link = 100 * common >= percent * (size[x] + size[y] - common)
        return x[link], y[link]

    def links(cell: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        # By size: blocks far from the diagonal have no similar sizes.
        cell = cell.take(pa.array(np.argsort(pc.binary_length(cell["tokens"]).to_numpy(), kind="stable")))
        ids = np.asarray(cell["id"])
        _, tree = np.unique(np.asarray(cell["root"]), return_inverse=True)
        sets = [np.frombuffer(t.as_buffer(), dtype=np.uint64) for t in cell["tokens"]]
        size = np.array([len(t) for t in sets])
        both = np.asarray(cell["x"]) & np.asarray(cell["y"])
        at_x, at_y = (np.flatnonzero(np.asarray(cell[c])) for c in "xy")
        kept_x, kept_y = [ids[:0]], [ids[:0]]
        for i in range(0, len(at_x), step):
            for j in range(0, len(at_y), step):
                x, y = block(sets, size, tree, both, at_x[i:i + step], at_y[j:j + step])
                if len(x):
                    kept = forest(tree[x], tree[y], len(tree))
                    x, y = x[kept], y[kept]
                    tree = joined(tree, tree[x], tree[y])
                    kept_x.append(ids[x])
                    kept_y.append(ids[y])
        return np.concatenate(kept_x), np.concatenate(kept_y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in whole_cells(batches, key):
            a, b = links(cell)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def linked(tokens: DataFrame, sets: DataFrame, lists: DataFrame, percent: int, components,
           may: Filter | None = None, cell_sets: int = CELL_SETS, cell_tokens: int = CELL_TOKENS) -> DataFrame:
    """id, root of every set that is linked with another: the least id of its component.

    ``tokens``: id, tokens. ``sets``: id, size. ``lists``: key, id (staged).
    """
    sizes = sets.select("id", "size")
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)
    own = lambda k: F.pmod(F.xxhash64("id"), F.col(k)).cast("int")
    each = lambda k: F.explode(F.sequence(zero, F.col(k) - 1))

    def blocks(cond: F.Column | bool = True) -> F.Column:
        """How many blocks the rows of a group take."""
        cond = F.lit(cond) if cond is True else cond
        n, total = F.count(F.when(cond, 1)), F.coalesce(F.sum(F.when(cond, F.col("size"))), F.lit(0))
        return F.greatest(F.lit(1), F.ceil(n / cell_sets), F.ceil(total / cell_tokens)).cast("int")

    def led(rows: DataFrame) -> DataFrame:
        """key, id with the key's lead."""
        leads = rows.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead != last")
        return rows.join(stage(leads.select("key", "lead"), "list-leads"), "key")

    def with_lead(groups: DataFrame) -> DataFrame:
        """lead, id, size: the groups and their leads."""
        everyone = groups.select("lead", "id").union(groups.select("lead", F.col("lead").alias("id"))).distinct()
        return stage(everyone.join(sizes, "id").select("lead", "id", "size"), "groups")

    # First, each set with the lead that it shares most keys with.
    shared = led(lists).where("id != lead").groupBy("lead", "id").agg(F.count(F.lit(1)).alias("n"))
    best = with_lead(shared.groupBy("id").agg(F.max(F.struct("n", "lead")).alias("b")).select(F.col("b.lead").alias("lead"), "id"))
    counts = stage(best.groupBy("lead").agg(blocks().alias("k")), "group-blocks")
    best = best.join(counts, "lead")
    both = best.where("k = 1 or id != lead").select(
        "lead", zero.alias("r"), own("k").alias("c"), "id", F.col("id").alias("root"), (F.col("k") == 1).alias("x"), yes.alias("y"))
    leads = best.where("k > 1 and id = lead").select("lead", zero.alias("r"), each("k").alias("c"), "id", F.col("id").alias("root"), yes.alias("x"), no.alias("y"))
    near_lead = stage(compared(both.union(leads), tokens, percent, may), "group-links")
    # Then lists that hold several components.
    rooted = stage(lists.join(components(near_lead), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")), "rooted")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    rooted = rooted.join(stage(mixed, "mixed-lists"), "key")
    roots = rooted.select("id", "root").distinct()
    groups = with_lead(led(rooted.select("key", "id"))).join(roots, "id")
    most = groups.groupBy("lead", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("lead").agg(F.max(F.struct("n", "root")).alias("most"))
    most = stage(most.select("lead", F.col("most.root").alias("main")), "main-roots")
    groups = stage(groups.join(most, "lead"), "groups")
    outside = F.col("root") != F.col("main")
    shape = groups.groupBy("lead").agg(blocks().alias("kc"), blocks(outside).alias("kr"))
    groups = groups.join(stage(shape, "group-blocks"), "lead")
    small = groups.where("kc = 1").select("lead", zero.alias("r"), zero.alias("c"), "id", "root", yes.alias("x"), yes.alias("y"))
    rows = groups.where((F.col("kc") > 1) & outside).select("lead", own("kr").alias("r"), each("kc").alias("c"), "id", "root", yes.alias("x"), no.alias("y"))
    columns = groups.where("kc > 1").select("lead", each("kr").alias("r"), own("kc").alias("c"), "id", "root", no.alias("x"), yes.alias("y"))
    found = stage(compared(small.union(rows).union(columns), tokens, percent, may), "group-links")
    return components(found.union(near_lead))


def least_shared(k: int, percent: int, miss: float = MISS) -> int:
    """The most values that similar sets share of k of their union, but for a chance of ``miss`` (Chernoff, without replacement)."""
    p = percent / 100

    def tail(c: int) -> float:
        """A bound on the chance of fewer than c."""
        q = (c - 1) / k
        if q <= 0:
            return (1 - p) ** k
        return math.exp(-k * (q * math.log(q / p) + (1 - q) * math.log((1 - q) / (1 - p)))) if q < p else 1.0

    if percent >= 100:
        return k
    return max((c for c in range(1, k + 1) if tail(c) <= miss), default=1)


def shared_of(sizes: np.ndarray, k: int, percent: int) -> np.ndarray:
    """How many of a set's k least hashes a similar set has among its own."""
    small = sizes * 100 <= k * percent  # a similar set is retained whole too
    shared = np.where(small, -(-sizes * percent // 100), least_shared(k, percent))
    return np.minimum(shared, np.minimum(sizes, k))


def sketched(sets: DataFrame) -> DataFrame:
    """id of the sets that can have a similar one. ``sets``: id, least, sketch (its least hashes, ``least`` of which a similar set shares)."""
    values = sets.select("id", "least", F.explode("sketch").alias("value"))
    often = stage(values.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("value"), "sketch-often")
    met = values.join(often, "value").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("least").alias("least"))
    return met.where("n >= least").select("id")
