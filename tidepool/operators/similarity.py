"""Exact cosine similarity: top-k (T2, T4), max similarity (A2) and the
order-aware near-duplicate test (J5).

Score = dot(q, x) / (|q| |x|). Zero vectors are never candidates; a zero query
has no top-k rows and a max similarity of 0.0. A vector with a NULL, NaN or
infinite component counts as no vector. Vectors are scaled by a power of two
before the norm (exact), so very small and very large ones neither underflow nor
overflow. Vectors of different dimensions raise, whichever plan is taken. Ties
rank by id ascending.

Two physical plans share one NumPy kernel:

* **broadcast scan** - when the query side is small (at most 65,536 rows and
  32 MiB of vectors, checked at run time by one aggregate) its matrix is
  broadcast and every index partition is scored in place, in sub-blocks of
  bounded size: no shuffle of the index at all;
* **grid** - otherwise index rows are put into groups by ball (nearest pivot of a bounded
  sample) and by range of order value, queries into groups by ball, both in parts that fit
  a bounded number of bytes. A query row is sent to those index groups only that the
  bounds of ``pruning.py`` leave (and, where only earlier rows count, to groups with an earlier
  row: cells above the diagonal are not shipped); an index row to the query groups of
  which some query needs its group. The rows of a cell come sorted, its index rows first: a task
  holds those (bounded) and scores its query rows as they stream by, in sub-blocks, skipping by
  prefix bounds, keeping a running top-k / max per query. A final ``row_number`` / ``max`` over the
  cells gives the exact answer. In the worst case (nothing can be pruned) work is O(|Q| |X| d) as
  for any exact search. No row pair is ever materialised.

Of a sub-block, a single-precision product tells which pairs can still matter (its error is
bounded by ``single_slack``); only those are scored, in double precision.

For the best similarity, equal vectors are one class (by a 128-bit fingerprint) in the grid: only the
row with the least order value is an index row, and a query with an equal vector before it has
its answer, 1.0, without a cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.vector import finite, nonzero
from tidepool.operators.pruning import MIN_PRUNED_ROWS, Counters, Groups, Model, heads, leading_axes, runs, single_slack, units
from tidepool.session import ship_package, stage

CELL_BYTES = 32 << 20  # vector bytes of one side of one grid cell; a task holds one index side
MAX_BLOCK_ROWS = 1024  # sub-block rows: bounds one score matrix (4 MiB in single precision)
DENSE = 8  # a sub-block of which more than 1 in so many pairs matter is scored whole
PAIR_BYTES = 8 << 20  # of vectors that are gathered at once to score single pairs
CELLS_PER_CORE = 3
SAMPLE_BYTES = 4 << 20  # of the index, for pivots, axes and floors
MAX_BALLS = 256
ORDER_RANGES = 32
FEW_GROUPS = 64  # index groups are joined up to that share of the index: a query row is shipped to each group it needs
BROADCAST_ROWS = 65536  # query rows that may be broadcast ...
BROADCAST_BYTES = 32 << 20  # ... and their vector bytes

_TOPK_SCHEMA = "qid long, id long, score double"
_MAX_SCHEMA = "qid long, score double"


def _cell_rows(dim: int) -> int:
    return int(max(64, CELL_BYTES // (8 * max(1, dim))))


def _matrix(col: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if n == 0:
        return np.zeros((0, 0))
    sizes = col.value_lengths().to_numpy(zero_copy_only=False)
    if sizes.min() != sizes.max():
        raise ValueError(f"vectors of different dimension: {sizes.min()} and {sizes.max()}")
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(n, -1)
    # A power of two leaves every digit, so integer-valued vectors still tie exactly.
    return np.ldexp(flat, -np.frexp(np.abs(flat).max(axis=1))[1][:, None])


def _scores(q: np.ndarray, x: np.ndarray, qn: np.ndarray, xn: np.ndarray) -> np.ndarray:
    # Integer-valued vectors give exact dots, so equal vectors tie exactly.
    return (q @ x.T) / np.multiply.outer(qn, xn)


def _norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", m, m))


class _TopK:
    """Running top-k per query row, ordered by (score desc, id asc)."""

    def __init__(self, qids: np.ndarray, k: int):
        self.qids = qids
        self.k = k
        self.scores = np.full((len(qids), k), -np.inf)
        self.ids = np.full((len(qids), k), np.iinfo(np.int64).max)

    def floor(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, rows: np.ndarray, s: np.ndarray, xids: np.ndarray) -> None:
        """Scores of some query rows against some index rows."""
        kk = min(self.k, s.shape[1])
        if kk == 0:
            return
        if s.shape[1] > kk:
            part = np.argpartition(-s, kk - 1, axis=1)[:, :kk]
            cand_s, cand_i = np.take_along_axis(s, part, axis=1), xids[part]
            kth = cand_s.min(axis=1)
            ties = (s >= kth[:, None]).sum(axis=1) > kk
            if ties.any():  # equal scores straddle the cut: decide by id, rows at once
                at = np.nonzero(ties)[0]
                sub = s[at]
                order = np.lexsort((np.broadcast_to(xids, sub.shape), -sub), axis=-1)[:, :kk]
                cand_s[at] = np.take_along_axis(sub, order, axis=1)
                cand_i[at] = xids[order]
        else:
            cand_s = s
            cand_i = np.broadcast_to(xids, s.shape)
        self._merge(rows, cand_s, cand_i)

    def add_pairs(self, rows: np.ndarray, s: np.ndarray, xids: np.ndarray) -> None:
        """Scores of single pairs, in order of the query rows."""
        at, first, n = np.unique(rows, return_index=True, return_counts=True)
        place = np.repeat(np.arange(len(at)), n), np.arange(len(rows)) - np.repeat(first, n)
        cand_s = np.full((len(at), n.max()), -np.inf)
        cand_i = np.full(cand_s.shape, np.iinfo(np.int64).max)
        cand_s[place], cand_i[place] = s, xids
        self._merge(at, cand_s, cand_i)

    def _merge(self, rows: np.ndarray, cand_s: np.ndarray, cand_i: np.ndarray) -> None:
        all_s = np.concatenate([self.scores[rows], cand_s], axis=1)
        all_i = np.concatenate([self.ids[rows], cand_i], axis=1)
        order = np.lexsort((all_i, -all_s), axis=-1)[:, : self.k]
        self.scores[rows] = np.take_along_axis(all_s, order, axis=1)
        self.ids[rows] = np.take_along_axis(all_i, order, axis=1)

    def batch(self) -> pa.RecordBatch:
        keep = np.isfinite(self.scores)
        rows = np.nonzero(keep)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.qids[rows[0]], pa.int64()),
                pa.array(self.ids[keep], pa.int64()),
                pa.array(self.scores[keep], pa.float64()),
            ],
            names=["qid", "id", "score"],
        )


class _Max:
    """Running max per query row; -inf while no candidate was seen."""

    def __init__(self, qids: np.ndarray):
        self.qids = qids
        self.best = np.full(len(qids), -np.inf)

    def floor(self) -> np.ndarray:
        return self.best

    def add(self, rows: np.ndarray, s: np.ndarray, xids: np.ndarray) -> None:
        if s.shape[1]:
            self.best[rows] = np.maximum(self.best[rows], s.max(axis=1))

    def add_pairs(self, rows: np.ndarray, s: np.ndarray, xids: np.ndarray) -> None:
        np.maximum.at(self.best, rows, s)

    def batch(self) -> pa.RecordBatch:
        keep = np.isfinite(self.best)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.qids[keep], pa.int64()), pa.array(self.best[keep], pa.float64())],
            names=["qid", "score"],
        )


def _new_state(mode: str, k: int, qids: np.ndarray):
    return _TopK(qids, k) if mode == "topk" else _Max(qids)


class _Side:
    """One side's rows of a cell, by order value, so that sub-blocks cover narrow order ranges."""

    def __init__(self, ids, ords, mat, axes, floors=None):
        o = np.argsort(ords, kind="stable")
        self.ids, self.ords, self.mat = ids[o], ords[o], mat[o]
        self.norms = _norms(self.mat)
        self.floors = np.full(len(o), -np.inf) if floors is None else floors[o]
        unit = self.mat / self.norms[:, None]
        self.unit = unit.astype(np.float32)
        self.head = heads(unit, axes) if axes is not None else None

    def block(self, i: int, n: int) -> _Side:
        part = _Side.__new__(_Side)
        for name, value in vars(self).items():
            setattr(part, name, None if value is None else value[i:i + n])
        return part

    def blocks(self, n: int) -> list[_Side]:
        return [self.block(i, n) for i in range(0, len(self.ids), n)]


def _side(t, axes, floors=None) -> _Side:
    n = t.num_rows
    number = lambda c: np.asarray(t.column(c)).astype(np.int64)
    return _Side(number("id"), number("ord"), _matrix(t.column("v"), n), axes, floors)


def _score_block(state, q: _Side, x: _Side, earlier_only: bool, counters: Counters | None = None) -> None:
    if len(x.ids) == 0 or len(q.ids) == 0:
        return
    if counters:
        counters.add("blocks", 1)
    rows, cols = np.arange(len(q.ids)), np.arange(len(x.ids))
    floor = np.maximum(q.floors, state.floor())
    if earlier_only and x.ords.min() >= q.ords.max():
        rows = rows[:0]  # no index row precedes any query row: nothing to compare
    elif q.head is not None and min(len(rows), len(cols)) >= MIN_PRUNED_ROWS and np.isfinite(floor).any():
        may = q.head @ x.head.T >= (floor - 2 * single_slack(q.head.shape[1])).astype(np.float32)[:, None]
        if earlier_only and x.ords.max() >= q.ords.min():
            may &= x.ords[None, :] < q.ords[:, None]
        rows, cols = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
    if not len(rows):
        if counters:
            counters.add("skipped", 1)
        return
    if counters:
        counters.add("pairs", len(rows) * len(cols))
    # Which pairs can matter, in single precision.
    s = q.unit[rows] @ x.unit[cols].T
    if earlier_only and x.ords.max() >= q.ords.min():
        s[x.ords[None, cols] >= q.ords[rows, None]] = -np.inf
    slack = single_slack(q.mat.shape[1])
    low, top = floor[rows] - slack, s.max(axis=1)
    if isinstance(state, _Max):
        low = np.maximum(low, top - 2 * slack)
    # Of rows without a candidate, nothing does.
    low = np.maximum(low, np.finfo(np.float32).min).astype(np.float32)
    hit = s >= low[:, None]
    n = np.count_nonzero(hit)
    if n > hit.size // DENSE:
        at, to = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
        rows, cols = rows[at], cols[to]
        s = _scores(q.mat[rows], x.mat[cols], q.norms[rows], x.norms[cols])
        if earlier_only:
            s = np.where(x.ords[None, cols] < q.ords[rows, None], s, -np.inf)
        state.add(rows, s, x.ids[cols])
    elif n:
        i, j = np.nonzero(hit)
        i, j = rows[i], cols[j]
        step = max(1, PAIR_BYTES // (8 * q.mat.shape[1]))
        for k in range(0, n, step):
            a, b = i[k:k + step], j[k:k + step]
            state.add_pairs(a, np.einsum("ij,ij->i", q.mat[a], x.mat[b]) / (q.norms[a] * x.norms[b]), x.ids[b])


def _score_cells(batches: Iterator[pa.RecordBatch], axes, mode: str, k: int, earlier_only: bool,
                 counters: Counters | None = None, sub: int = MAX_BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    """Rows (qg, xg, query, id, v, ord, floor) sorted by cell, then index rows before query rows, then order value.

    Holds the index side of one cell; query rows are scored as they come.
    """
    cell, index, met = None, [], False
    for rb in batches:
        if not rb.num_rows:
            continue
        keys = np.stack([np.asarray(rb.column(c)).astype(np.int64) for c in ("qg", "xg", "query")], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), rb.num_rows], strict=True):
            qg, xg, query = keys[i].tolist()
            part = rb.slice(i, j - i)
            if (qg, xg) != cell:
                cell, index, met = (qg, xg), [], False
            if not query:
                index.extend(_side(part, axes).blocks(sub))
                continue
            if not index:
                continue
            if counters:
                if not met:
                    counters.add("cells", 1)
                    counters.add("index_rows", sum(len(x.ids) for x in index))
                counters.add("query_rows", part.num_rows)
            met = True
            for qs in _side(part, axes, np.asarray(part.column("floor"))).blocks(sub):
                state = _new_state(mode, k, qs.ids)
                for x in index:
                    _score_block(state, qs, x, earlier_only, counters)
                yield state.batch()


def _prepare(df: DataFrame, id_col: str, v_col: str, ord_col: str | None = None) -> DataFrame:
    """(id, v, ord) without zero, NULL and non-finite vectors; v as ARRAY<DOUBLE>."""
    v = F.col(v_col).cast("array<double>")
    ordc = F.col(ord_col) if ord_col else F.col(id_col)
    return (
        df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), ordc.cast("long").alias("ord"))
        .where(F.col("v").isNotNull() & nonzero("v") & finite("v"))
    )


def _stats(df: DataFrame) -> tuple[int, int]:
    """(row count, dimension) in one pass; all vectors must share the dimension."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi")
    ).first()
    if row is None or not row.n:
        return 0, 0
    if row.lo != row.hi:
        raise ValueError(f"vectors of different dimension: {row.lo} and {row.hi}")
    return int(row.n), int(row.lo)


def _sample(index: DataFrame, dim: int, nx: int, balls: int) -> Model:
    """A bounded sample of the index, in an order that its ids do not determine."""
    n = max(64, SAMPLE_BYTES // (8 * max(1, dim)))
    h = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30))
    few = index.where(h < F.lit(math.ceil(min(1.0, 2 * n / nx) * (1 << 30))))  # about twice as many as are taken
    t = few.orderBy(h, "id").limit(n).toArrow()
    return Model.of(np.asarray(t.column("id")), np.asarray(t.column("ord")), _matrix(t.column("v"), t.num_rows), balls)


def _grid(index: DataFrame, queries: DataFrame, mode: str, k: int, earlier_only: bool,
          dim: int, nq: int, nx: int, least: float = -np.inf, counters: Counters | None = None) -> DataFrame:
    sc = index.sparkSession.sparkContext
    rows = _cell_rows(dim)
    # Small inputs: a few balls more than memory asks for, so that every core has some cells.
    balls = max(math.ceil(math.sqrt(CELLS_PER_CORE * sc.defaultParallelism)), math.ceil(nx / rows), math.ceil(nq / rows))
    model = sc.broadcast(_sample(index, dim, nx, min(balls, MAX_BALLS)))
    # Index groups: by ball and, where order counts, by range of order value.
    bounds = np.empty(0, np.int64)
    if earlier_only:
        cuts = [i / ORDER_RANGES for i in range(1, ORDER_RANGES)]
        bounds = np.array(sorted({int(x) for x in index.agg(F.percentile_approx("ord", cuts, 1000)).first()[0]}))

    def placed(rb) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group key, ball and angle of each row."""
        ball, angle = model.value.place(units(_matrix(rb.column(1), rb.num_rows)))
        reach = np.searchsorted(bounds, np.asarray(rb.column(2)))
        return ball * ORDER_RANGES + reach, ball, angle

    def describe(batches):
        for rb in batches:
            if rb.num_rows:
                key, ball, angle = placed(rb)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ball), rb.column(2), pa.array(angle)], names=["key", "ball", "ord", "angle"])

    known = index.mapInArrow(describe, "key long, ball long, ord long, angle double").groupBy("key", "ball").agg(
        F.count(F.lit(1)).alias("n"), F.min("ord").alias("earliest"), F.min("angle").alias("low"), F.max("angle").alias("high")).orderBy("key").collect()
    # Short neighbours in a ball are one group (every query row that needs a group is shipped to it); long ones go in parts by id.
    of, merged = _merged([(g.ball, g.n, g.low, g.high, g.earliest) for g in known], min(rows, math.ceil(nx / FEW_GROUPS)))
    first = np.concatenate([[0], np.cumsum([math.ceil(g[1] / rows) for g in merged])])
    keys = np.array([g.key for g in known])
    groups = sc.broadcast(Groups(*(np.array([g[c] for g in merged]) for c in (0, 2, 3, 4)), first))

    def assign(batches):
        for rb in batches:
            if rb.num_rows:
                at = of[np.searchsorted(keys, placed(rb)[0])]
                xg = first[at] + np.asarray(rb.column(3)) % (first[at + 1] - first[at])
                yield pa.RecordBatch.from_arrays([pa.array(xg), *rb.columns[:3]], names=["xg", "id", "v", "ord"])

    keyed = index.select("id", "v", "ord", F.pmod(F.xxhash64("id", F.lit("x")), F.lit(1 << 30)).alias("h"))
    xrows = keyed.mapInArrow(assign, "xg long, id long, v array<double>, ord long")
    # Query groups: by ball, long ones in parts by id.
    counts = {r.ball: r["count"] for r in queries.select("id", "v", "ord").mapInArrow(
        describe, "key long, ball long, ord long, angle double").groupBy("ball").count().collect()}
    splits = [math.ceil(counts.get(b, 0) / rows) for b in range(max(counts) + 1)]
    qfirst = sc.broadcast(np.concatenate([[0], np.cumsum(splits)]))

    def route(batches):
        m, g, at = model.value, groups.value, qfirst.value
        for rb in batches:
            if not rb.num_rows:
                continue
            u = units(_matrix(rb.column(1), rb.num_rows))
            ids, ords, h = (np.asarray(rb.column(c)).astype(np.int64) for c in (0, 2, 3))
            floors = m.floors(u, ords, k, earlier_only, least)
            for run in runs(rb.num_rows, max(len(m.pivots), len(g.ball), int(g.first[-1]))):
                angles = m.angles(u[run])
                ball = angles.argmin(axis=1)
                qg = at[ball] + h[run] % np.maximum(at[ball + 1] - at[ball], 1)
                who, group = g.needed(angles, floors[run], ords[run], earlier_only)
                n = g.first[group + 1] - g.first[group]
                xg = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(g.first[group], n)
                end = np.cumsum(np.bincount(who, n, len(ball)).astype(np.int64))
                xgs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], end]), pa.int32()), pa.array(xg, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qg), xgs, pa.array(ids[run]), rb.column(1).slice(run.start, len(ball)), pa.array(ords[run]), pa.array(floors[run])],
                    names=["qg", "xgs", "id", "v", "ord", "floor"])

    # Each query row once, with the parts it needs: read for the cells that occur and for their rows.
    keyed = queries.select("id", "v", "ord", F.pmod(F.xxhash64("id", F.lit("q")), F.lit(1 << 30)).alias("h"))
    routed = stage(keyed.mapInArrow(route, "qg long, xgs array<long>, id long, v array<double>, ord long, floor double"), "routed-queries")
    needed = routed.select("qg", F.explode("xgs").alias("xg")).distinct()
    qrep = routed.select("qg", F.explode("xgs").alias("xg"), F.lit(1).alias("query"), "id", "v", "ord", "floor")
    xrep = xrows.join(needed, "xg").select("qg", "xg", F.lit(0).alias("query"), "id", "v", "ord", F.lit(0.0).alias("floor"))
    cells = xrep.unionByName(qrep).repartition("qg", "xg").sortWithinPartitions("qg", "xg", "query", "ord")
    axes, sub = sc.broadcast(model.value.axes), MAX_BLOCK_ROWS
    return cells.mapInArrow(lambda b: _score_cells(b, axes.value, mode, k, earlier_only, counters, sub),
                            _TOPK_SCHEMA if mode == "topk" else _MAX_SCHEMA)


def _merged(groups: list[tuple], rows: int) -> tuple[np.ndarray, list[tuple]]:
    """Neighbours (ball, n, low, high, earliest) of one ball joined up to ``rows`` rows; and for each group the joined one it is in."""
    of, out = [], []
    for g in groups:
        if out and out[-1][0] == g[0] and out[-1][1] + g[1] <= rows:
            ball, n, low, high, earliest = out.pop()
            g = (ball, n + g[1], min(low, g[2]), max(high, g[3]), earliest if g[4] is None else g[4] if earliest is None else min(earliest, g[4]))
        out.append(g)
        of.append(len(out) - 1)
    return np.array(of), out


def _broadcast(index: DataFrame, tbl: pa.Table, mode: str, k: int, earlier_only: bool,
               least: float = -np.inf, counters: Counters | None = None) -> DataFrame:
    whole = _matrix(tbl.column("v"), tbl.num_rows)
    # Axes of the queries themselves: the bound holds for any.
    axes = leading_axes(units(whole[:max(64, SAMPLE_BYTES // (8 * max(1, whole.shape[1])))]))
    bq = index.sparkSession.sparkContext.broadcast((_side(tbl, axes, np.full(tbl.num_rows, least)), axes))
    schema = _TOPK_SCHEMA if mode == "topk" else _MAX_SCHEMA

    sub = MAX_BLOCK_ROWS

    def kernel(batches):
        q, axes_ = bq.value
        # One running state per query sub-block keeps every score matrix
        # at most sub x sub.
        parts = [(qs, _new_state(mode, k, qs.ids)) for qs in q.blocks(sub)]
        for rb in batches:
            if not rb.num_rows:
                continue
            if (width := pc.list_value_length(rb.column(1)).to_numpy(zero_copy_only=False)).max() != q.mat.shape[1] or width.min() != q.mat.shape[1]:
                raise ValueError(f"index dimension {width.min()} to {width.max()} differs from query dimension {q.mat.shape[1]}")
            x = _side(rb, axes_)
            for block in x.blocks(sub):
                for qs, state in parts:
                    _score_block(state, qs, block, earlier_only, counters)
        for _, state in parts:
            yield state.batch()

    return index.mapInArrow(kernel, schema)


def _fingerprinted(df: DataFrame) -> DataFrame:
    """With two 64-bit hashes of the vector: equal vectors have equal ones (a negative zero is a zero)."""
    return df.withColumns({"f1": F.xxhash64("v"), "f2": F.xxhash64(F.lit(1), "v")})


def _classes(index: DataFrame) -> DataFrame:
    """id, v, ord, f1, f2 of one row of each class of equal vectors: the one with the least order value."""
    least = F.min_by(F.struct("id", "v"), F.struct("ord", "id")).alias("row")
    return stage(_fingerprinted(index).groupBy("f1", "f2").agg(least, F.min("ord").alias("ord")).select("row.id", "row.v", "ord", "f1", "f2"), "vector-classes")


def _plan(index, queries, mode, k, earlier_only, strategy, least=-np.inf, counters=None):
    """Candidates (qid, [id,] score) that hold each query's answer; None if there are none."""
    ship_package(index.sparkSession)
    nq, qdim = _stats(queries)
    if nq == 0:
        return None
    small = nq <= BROADCAST_ROWS and (strategy == "broadcast" or nq * qdim * 8 <= BROADCAST_BYTES)
    if small and strategy not in ("grid", "blocked"):
        # The index is only scanned; the kernel checks the dimension of its rows.
        return _broadcast(index, queries.toArrow(), mode, k, earlier_only, least, counters)
    if mode == "max":
        index = _classes(index)
    nx, dim = _stats(index)
    if nx == 0:
        return None
    if qdim != dim:
        raise ValueError(f"query dimension {qdim} differs from index dimension {dim}")
    if mode != "max":
        return _grid(index, queries, mode, k, earlier_only, dim, nq, nx, least, counters)
    # A query with an equal vector before it needs no cell; of the rest, equal ones that look at the same rows are one.
    first = index.select("f1", "f2", F.col("ord").alias("first"))
    met = F.col("first").isNotNull() & ((F.col("first") < F.col("ord")) if earlier_only else F.lit(True))
    marked = _fingerprinted(queries).join(first, ["f1", "f2"], "left").withColumn("met", met)
    answered = marked.where("met").select(F.col("id").alias("qid"), F.lit(1.0).alias("score"))
    open_ = marked.where("not met")
    alike = ["f1", "f2"] + ["ord"] * earlier_only
    one = open_.groupBy(*alike).agg(F.min_by("v", "id").alias("v"), F.min("id").alias("rep"), *([] if earlier_only else [F.min("ord").alias("ord")]))
    one = stage(one.select(F.col("rep").alias("id"), "v", "ord", "f1", "f2"), "query-classes")
    n_open, _ = _stats(one)
    if n_open == 0:
        return answered
    found = _grid(index, one, mode, k, earlier_only, dim, n_open, nx, least, counters).groupBy("qid").agg(F.max("score").alias("score"))
    members = open_.select(F.col("id").alias("member"), *alike).join(one.select(F.col("id").alias("qid"), *alike), alike)
    return answered.unionByName(members.join(found, "qid").select(F.col("member").alias("qid"), "score"))


def top_k(index: DataFrame, queries: DataFrame, k: int, *, index_id: str = "id",
          index_v: str = "v", query_id: str = "id", query_v: str = "v",
          strategy: str = "auto", counters: Counters | None = None) -> DataFrame:
    """The k most similar index rows per query row.

    Returns ``(qid, rank, id, score)``; rank starts at 1. In the grid, each query's k-th best score in a
    bounded sample of the index is the floor that prunes the groups it is sent to.
    """
    spark = index.sparkSession
    x = _prepare(index, index_id, index_v)
    q = _prepare(queries, query_id, query_v)
    cand = _plan(x, q, "topk", k, False, strategy, counters=counters)
    if cand is None:
        return spark.createDataFrame([], "qid long, rank int, id long, score double")
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("id").asc())
    return (
        cand.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= F.lit(k))
        .select("qid", F.col("rank").cast("int"), "id", "score")
    )


def max_similarity(index: DataFrame, queries: DataFrame, *, earlier_only: bool = False,
                   index_id: str = "id", index_v: str = "v", query_id: str = "id",
                   query_v: str = "v", ord_col: str | None = None,
                   strategy: str = "auto", counters: Counters | None = None) -> DataFrame:
    """A2: best cosine of each query row against the index; 0.0 when none.

    ``earlier_only`` limits candidates to index rows whose order value (``ord_col``,
    default the id) is below the query's (J5).
    Every query row is returned, including zero or NULL query vectors (0.0).
    """
    all_q = queries.select(F.col(query_id).cast("long").alias("qid")).distinct()
    x = _prepare(index, index_id, index_v, ord_col)
    q = _prepare(queries, query_id, query_v, ord_col)
    cand = _plan(x, q, "max", 1, earlier_only, strategy, counters=counters)
    if cand is None:
        return all_q.withColumn("score", F.lit(0.0))
    best = cand.groupBy("qid").agg(F.max("score").alias("score"))
    return all_q.join(best, "qid", "left").select(
        "qid", F.coalesce(F.col("score"), F.lit(0.0)).alias("score")
    )


def near_duplicates(vectors: DataFrame, new_ids: DataFrame, threshold: float,
                    *, ord_col: str | None = None, strategy: str = "auto", counters: Counters | None = None) -> DataFrame:
    """New rows whose best cosine against every row with a smaller id meets
    ``threshold``. Store rows have smaller ids than every new row, so "store or
    earlier in the load" is exactly ``other.id < new.id``.

    ``vectors``: (id, v) of the store and the new rows; ``new_ids``: (id).
    When ids do not carry the order, ``ord_col`` does: store rows get a value
    below every new row's. Returns ``(id, score)``.
    """
    queries = vectors.join(new_ids.select(F.col("id").cast("long")), "id", "left_semi")
    if threshold <= 0.0:  # a row without candidates (0.0) would qualify too
        best = max_similarity(vectors, queries, earlier_only=True, ord_col=ord_col, strategy=strategy)
        return best.where(F.col("score") >= F.lit(threshold)).select(F.col("qid").alias("id"), "score")
    x = _prepare(vectors, "id", "v", ord_col)
    q = _prepare(queries, "id", "v", ord_col)
    cand = _plan(x, q, "max", 1, True, strategy, threshold, counters)
    if cand is None:
        return vectors.sparkSession.createDataFrame([], "id long, score double")
    # Rows without any candidate score 0.0 < threshold: no need to add them back.
    best = cand.groupBy("qid").agg(F.max("score").alias("score"))
    return best.where(F.col("score") >= F.lit(threshold)).select(F.col("qid").alias("id"), "score")
