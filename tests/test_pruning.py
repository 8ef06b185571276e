"""Exact pruning, equal-vector classes, order-range cells, top-k floors, and the approximate search."""

from __future__ import annotations

import itertools
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tidepool.operators import similarity as S
from tidepool.operators.approximate import expected_recall, near_duplicates_approx
from tidepool.operators.pruning import Counters, Model, units


def vecs(spark, m, ids=None):
    return spark.createDataFrame([(int(i), [float(a) for a in r]) for i, r in zip(ids if ids is not None else range(len(m)), m)], "id long, v array<double>")


def clustered(seed, clusters, each, dim, noise=0.08):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    x = np.repeat(centres, each, axis=0) + noise * rng.normal(size=(clusters * each, dim))
    return x[rng.permutation(len(x))]


def earlier_best(x):
    u = units(x)
    s = np.where(np.tri(len(x), k=-1, dtype=bool), u @ u.T, -np.inf)
    return s.max(axis=1)


@pytest.fixture()
def small_cells(monkeypatch):
    monkeypatch.setattr(S, "MAX_BLOCK_ROWS", 64)
    monkeypatch.setattr(S, "CELL_BYTES", 8 * 48 * 100)


@pytest.mark.parametrize("strategy", ["grid", "broadcast"])
def test_clustered_vectors_skip_blocks_and_keep_results(spark, small_cells, strategy):
    x = clustered(1, 24, 40, 48)
    df = vecs(spark, x)
    seen = Counters(spark.sparkContext)
    got = {r.id: r.score for r in S.near_duplicates(df, df.select("id"), 0.93, strategy=strategy, counters=seen).collect()}
    best = earlier_best(x)
    assert got.keys() == set(np.flatnonzero(best >= 0.93).tolist()) and len(got) > 500
    assert all(got[i] == pytest.approx(best[i], abs=1e-12) for i in got)
    done = seen.values()
    if strategy == "grid":
        assert done["pairs"] < 0.15 * len(x) ** 2  # all pairs before the diagonal: 0.5
    else:
        assert done["pairs"] < 0.8 * len(x) ** 2


def test_prefix_bound_skips_whole_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "MAX_BLOCK_ROWS", 40)
    rng = np.random.default_rng(2)
    # Clusters in order of id: blocks of ids hold one cluster each.
    x = np.repeat(rng.normal(size=(20, 48)), 40, axis=0) + 0.05 * rng.normal(size=(800, 48))
    df = vecs(spark, x).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        seen = Counters(spark.sparkContext)
        got = S.near_duplicates(df, df.select("id"), 0.93, strategy="broadcast", counters=seen).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 780
    done = seen.values()
    assert done["skipped"] >= 0.9 * done["blocks"]


def test_unclustered_vectors_keep_results(spark, small_cells):
    x = np.random.default_rng(3).normal(size=(400, 48))
    x[200:] = x[:200] + 0.3 * np.random.default_rng(4).normal(size=(200, 48))
    df = vecs(spark, x)
    got = {r.id for r in S.near_duplicates(df, df.select("id"), 0.93, strategy="grid").collect()}
    assert got == set(np.flatnonzero(earlier_best(x) >= 0.93).tolist()) and got


@pytest.mark.parametrize("earlier_only", [True, False])
def test_a_vector_in_a_third_of_the_rows_is_one_row(spark, small_cells, earlier_only):
    x = clustered(5, 15, 40, 48)
    x[::3] = 7 * x[0]
    df = vecs(spark, x)
    seen, plain = Counters(spark.sparkContext), Counters(spark.sparkContext)
    got = {r.qid: r.score for r in S.max_similarity(df, df, earlier_only=earlier_only, strategy="grid", counters=seen).collect()}
    if earlier_only:
        want = earlier_best(x)
        want[0] = 0.0
    else:
        want = (units(x) @ units(x).T).max(axis=1)
    assert all(got[i] == pytest.approx(want[i], abs=1e-12) for i in range(len(x)))
    done = seen.values()
    if not earlier_only:  # every query has an equal vector in the index
        assert done["cells"] == 0
    else:
        one = np.flatnonzero(np.arange(len(x)) % 3 != 0)
        alone = vecs(spark, np.concatenate([x[:1], x[one]]), [0, *one.tolist()])
        S.max_similarity(alone, alone, earlier_only=True, strategy="grid", counters=plain).collect()
        assert done["index_rows"] <= 1.05 * plain.values()["index_rows"]


def test_equal_queries_are_asked_once(spark, small_cells):
    x, rng = clustered(6, 10, 30, 48), np.random.default_rng(7)
    q = np.repeat(rng.normal(size=(5, 48)), 60, axis=0)
    seen = Counters(spark.sparkContext)
    got = {r.qid: r.score for r in S.max_similarity(vecs(spark, x), vecs(spark, q), strategy="grid", counters=seen).collect()}
    want = (units(q) @ units(x).T).max(axis=1)
    assert all(got[i] == pytest.approx(want[i], abs=1e-12) for i in range(300))
    assert seen.values()["pairs"] <= 5 * len(x)


def test_cells_above_the_diagonal_are_not_shipped(spark, small_cells, monkeypatch):
    # Nothing can be pruned by angle here, so only the order decides.
    x = np.random.default_rng(8).normal(size=(900, 48))
    df = vecs(spark, x)
    monkeypatch.setattr(S, "MAX_BALLS", 1)
    ordered, all_ = Counters(spark.sparkContext), Counters(spark.sparkContext)
    S.max_similarity(df, df, earlier_only=True, strategy="grid", counters=ordered).collect()
    other = vecs(spark, x + 1e-4, range(1000, 1900))  # no equal vectors, so no query is answered beforehand
    S.max_similarity(df, other, strategy="grid", counters=all_).collect()
    shipped = ordered.values()["query_rows"]
    # Parts of about 100 rows, 9 or more order ranges: a row goes to about half of the cells.
    full = len(x) * sum(1 for _ in range(S.ORDER_RANGES))
    assert shipped <= 0.6 * full
    best = earlier_best(x)
    got = {r.qid: r.score for r in S.max_similarity(df, df, earlier_only=True, strategy="grid").collect()}
    assert all(got[i] == pytest.approx(max(best[i], -1) if i else 0.0, abs=1e-12) for i in range(len(x)))


def test_top_k_floors_prune_groups(spark, small_cells):
    x = clustered(9, 24, 60, 48)
    index, queries = vecs(spark, x), vecs(spark, x[:200] + 0.01)
    seen = Counters(spark.sparkContext)
    got = {}
    for r in S.top_k(index, queries, 5, strategy="grid", counters=seen).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.id, r.score))
    scores = units(x[:200] + 0.01) @ units(x).T
    for i, row in enumerate(scores):
        want = np.lexsort((np.arange(len(x)), -row))[:5]
        assert [j for j, _ in got[i]] == want.tolist()
        assert [s for _, s in got[i]] == pytest.approx(row[want].tolist(), abs=1e-12)
    assert seen.values()["pairs"] < 0.3 * 200 * len(x)


def test_floors_are_lower_bounds():
    x = clustered(10, 8, 50, 32)
    m = Model.of(np.arange(100), np.arange(100), x[:100], 8)
    q = units(x[100:200])
    floors = m.floors(q, np.arange(100, 200), 10, False, -np.inf)
    kth = np.sort(q @ units(x).T, axis=1)[:, -10]
    assert (floors <= kth + 1e-12).all() and np.isfinite(floors).all()
    few = Model.of(np.arange(3), np.arange(3), x[:3], 2)
    assert np.isinf(few.floors(q, np.arange(100), 10, False, -np.inf)).all()


def test_approximate_recall(spark):
    x = clustered(11, 60, 12, 64, noise=0.23)
    df = vecs(spark, x)
    exact = {r.id for r in S.near_duplicates(df, df.select("id"), 0.93).collect()}
    best = earlier_best(x)
    assert len(exact) > 100 and best[list(exact)].min() < 0.94  # pairs at the threshold, too
    got = {r.id: r.score for r in near_duplicates_approx(df, df.select("id"), 0.93).collect()}
    assert got.keys() <= exact and all(s <= best[i] + 1e-12 for i, s in got.items())
    assert len(got) / len(exact) >= 0.9
    assert 0.96 < expected_recall(0.93) < 0.97 and expected_recall(0.99) > 0.999
    with pytest.raises(ValueError, match="positive"):
        near_duplicates_approx(df, df, 0.0)


def peak_mb(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def test_floors_of_many_queries_take_bounded_memory():
    x = np.random.default_rng(12).normal(size=(6000, 8))
    m = Model.of(np.arange(3000), np.arange(3000), x[:3000], 8)
    q, ords = units(x[3000:]), np.arange(3000) + 1500
    assert peak_mb(lambda: m.floors(q, ords, 1, True, 0.5)) < 32  # all pairs in double precision: 69 MB
    s = np.where(np.arange(3000) < ords[:, None], q @ units(x[:3000]).T, -np.inf).max(axis=1)
    got = m.floors(q, ords, 1, True, 0.5)
    assert (got <= np.maximum(s, 0.5)).all() and got == pytest.approx(np.maximum(s, 0.5), abs=1e-4)


def cell_rows(ids, v, query):
    n = len(ids)
    zero = pa.array(np.zeros(n, np.int64))
    v = pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1]).cast(pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays(
        [zero, zero, pa.array(np.full(n, query)), pa.array(ids), v, pa.array(ids), pa.array(np.full(n, -np.inf))],
        names=["qg", "xg", "query", "id", "v", "ord", "floor"])


@pytest.mark.parametrize("mode, k", [("max", 1), ("topk", 3)])
def test_query_rows_of_a_cell_stream_by(mode, k):
    rng = np.random.default_rng(13)
    index, queries = rng.normal(size=(500, 16)), rng.normal(size=(20_000, 16))
    ids = np.arange(500, 20_500)
    found = []

    def run():
        batches = [cell_rows(np.arange(500), index, 0)]
        stream = itertools.chain(batches, (cell_rows(ids[i:i + 500], queries[i:i + 500], 1) for i in range(0, 20_000, 500)))
        for b in S._score_cells(stream, None, mode, k, False):
            if not found or len(found) < 3:
                found.append(b)

    assert peak_mb(run) < 24
    s = units(queries[:500]) @ units(index).T
    want = np.sort(s, axis=1)[:, ::-1][:, :k]
    assert np.asarray(found[0]["score"]).reshape(500, k) == pytest.approx(want, abs=1e-12)


def test_many_equal_vectors_tie_by_id(spark, small_cells):
    rng = np.random.default_rng(14)
    x = np.repeat(rng.integers(-9, 9, size=(6, 8)).astype(float), 60, axis=0)
    got = {}
    for r in S.top_k(vecs(spark, x), vecs(spark, x[::60] + 0.0), 5, strategy="grid").orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    scores = (x[::60] @ x.T) / np.sqrt(np.multiply.outer((x[::60] ** 2).sum(axis=1), (x ** 2).sum(axis=1)))
    for i, row in enumerate(np.round(scores, 12)):
        assert got[i] == np.lexsort((np.arange(len(x)), -row))[:5].tolist()


def test_short_neighbours_in_a_ball_are_one_group():
    of, merged = S._merged([(0, 3, 0.1, 0.2, 7), (0, 4, 0.0, 0.15, 2), (0, 5, 0.3, 0.4, 9), (1, 1, 0.2, 0.2, 4)], 8)
    assert of.tolist() == [0, 0, 1, 2]
    assert merged == [(0, 7, 0.0, 0.2, 2), (0, 5, 0.3, 0.4, 9), (1, 1, 0.2, 0.2, 4)]
