"""Vector codec, index maintenance, ranking and max similarity."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import records_df
from pyspark.sql import functions as F

from tidepool.functions import vector as V
from tidepool.operators import changes as C
from tidepool.operators import similarity as S
from tidepool.operators.pruning import Counters


def vecs(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<double>")


@pytest.mark.parametrize("v", [[3.25, -7.5e-3, 1e18], [0.0], [-2.0 ** -40] * 5])
def test_codec_keeps_every_component(spark, v):
    df = spark.createDataFrame([(v,)], "v array<double>")
    assert df.select(V.decode(V.encode("v")).alias("b")).first().b == v


def test_codec_of_text(spark):
    texts = spark.createDataFrame([(1, ""), (2, "[]"), (3, "[7, 8.5]"), (4, None)], "k int, t string")
    assert {r.k: r.b for r in texts.select("k", V.decode("t").alias("b")).collect()} == {1: None, 2: [], 3: [7.0, 8.5], 4: None}
    with pytest.raises(Exception):
        texts.select(V.decode(F.concat("t", F.lit(",]"))).alias("b")).collect()


def test_saving_vectors_one_after_the_other(spark):
    """A record's vector is replaced each time; the index holds the last one that is not zero."""
    recs = records_df(spark, [(k, "q", "", "a", "", None) for k in (11, 12)])
    index = vecs(spark, [])
    for v, indexed in (([2.0, 5.0, -1.0], True), ([0.0, 0.0, 0.0], False), ([0.5, 0.5, 9.0], True)):
        recs, index = C.save_embeddings(recs, index, vecs(spark, [(12, v)]))
        assert {r.id: r.embedding for r in recs.collect()} == {11: None, 12: v}
        assert [(r.id, r.v) for r in index.collect()] == ([(12, v)] if indexed else [])
    assert [r.id for r in C.upsert_vectors(vecs(spark, [(5, [1.0]), (6, [2.0])]), vecs(spark, [(5, [0.0])])).collect()] == [6]
    for gone, left in (([12, 40], 0), ([40], 1)):
        assert C.clear_vectors(index, spark.createDataFrame([(g,) for g in gone], "id long")).count() == left


@pytest.mark.parametrize("strategy", ["broadcast", "grid"])
def test_ranking_by_angle(spark, strategy):
    # Angles of 10, 35, 80 and 140 degrees to the query, of different lengths; a zero vector is no candidate.
    degrees = {21: 80, 22: 10, 23: 140, 24: 35}
    rows = [(i, [(i - 20) * float(np.cos(np.radians(d))), (i - 20) * float(np.sin(np.radians(d)))]) for i, d in degrees.items()]
    index, query = vecs(spark, [*rows, (25, [0.0, 0.0])]), vecs(spark, [(1, [3.0, 0.0])])
    got = S.top_k(index, query, 10, strategy=strategy).orderBy("rank").collect()
    assert [(r.rank, r.id) for r in got] == [(1, 22), (2, 24), (3, 21), (4, 23)]
    assert [r.score for r in got] == pytest.approx([float(np.cos(np.radians(d))) for d in (10, 35, 80, 140)])
    assert [r.id for r in S.top_k(index, query, 1, strategy=strategy).collect()] == [22]
    assert S.max_similarity(index, query, strategy=strategy).first().score == pytest.approx(float(np.cos(np.radians(10))))


def test_nothing_to_compare(spark):
    query, zero = vecs(spark, [(1, [4.0, 1.0])]), vecs(spark, [(2, [0.0, 0.0])])
    for index in (vecs(spark, []), zero):
        assert S.top_k(index, query, 3).count() == 0 and S.max_similarity(index, query).first().score == 0.0
    assert S.top_k(query, zero, 3).count() == 0 and S.max_similarity(query, zero).first().score == 0.0


@pytest.mark.parametrize("strategy", ["broadcast", "grid"])
def test_top_k_matches_brute_force(spark, strategy, monkeypatch):
    # Small cells and sub-blocks: many grid cells, many sub-blocks per cell.
    monkeypatch.setattr(S, "MAX_BLOCK_ROWS", 16)
    monkeypatch.setattr(S, "CELL_BYTES", 8 * 6 * 64)
    rng = np.random.default_rng(7)
    x = rng.integers(0, 3, size=(300, 6)).astype(float)
    x[4] = 0
    x[10] = x[11]
    rows = [(int(i), [float(a) for a in r]) for i, r in enumerate(x)]
    idx = vecs(spark, rows)
    q = vecs(spark, rows[:40])
    got = {}
    for r in S.top_k(idx, q, 7, strategy=strategy).collect():
        got.setdefault(r.qid, []).append((r.rank, r.id))
    norms = np.linalg.norm(x, axis=1)
    for qi in range(40):
        if norms[qi] == 0:
            assert qi not in got
            continue
        sc = [(-(x[qi] @ x[j]) / (norms[qi] * norms[j]), j) for j in range(300) if norms[j] > 0]
        exp = [j for _, j in sorted(sc)[:7]]
        assert [i for _, i in sorted(got[qi])] == exp


def test_nonzero_and_cosine_columns(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    out = df.select(V.nonzero("a").alias("nz"), V.cosine("a", "b").alias("c")).collect()
    assert out[0].nz and out[0].c == pytest.approx(2 ** -0.5)
    assert not out[1].nz and out[1].c is None
    assert df.select(F.size("a")).count() == 2


@pytest.mark.parametrize("strategy", ["broadcast", "grid"])
def test_max_similarity_earlier_only_matches_brute_force(spark, strategy, monkeypatch):
    monkeypatch.setattr(S, "MAX_BLOCK_ROWS", 16)
    monkeypatch.setattr(S, "CELL_BYTES", 8 * 5 * 64)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(250, 5))
    x[3] = 0
    rows = [(int(i), [float(a) for a in r]) for i, r in enumerate(x)]
    df = vecs(spark, rows)
    got = {r.qid: r.score for r in S.max_similarity(df, df, earlier_only=True, strategy=strategy).collect()}
    norms = np.linalg.norm(x, axis=1)
    for i in range(250):
        cands = [x[i] @ x[j] / (norms[i] * norms[j]) for j in range(i) if norms[j] > 0 and norms[i] > 0]
        assert got[i] == pytest.approx(max(cands) if cands else 0.0, abs=1e-12)


def test_embedder_errors_and_breaker(spark):
    import pyarrow as pa

    from tidepool.operators.embed import embed

    calls = spark.sparkContext.accumulator(0)

    def broken(batch: pa.RecordBatch) -> pa.RecordBatch:
        calls.add(1)
        raise OSError("connection refused")

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        df = spark.range(0, 40, 1, 1).selectExpr("id", "'text' AS text")
        out = embed(df, embedder=broken, breaker=2).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == 40 and all(r.v is None for r in out)
    assert {r.error for r in out} == {"embedder error: OSError", "embedder unavailable"}
    assert calls.value == 2


def test_forced_broadcast_never_drops_queries(spark, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_ROWS", 5)
    rows = [(i, [float(i % 3 + 1), 1.0]) for i in range(20)]
    df = vecs(spark, rows)
    got = S.max_similarity(df, df, strategy="broadcast").collect()
    assert len(got) == 20
    assert len({r.qid for r in S.top_k(df, df, 2, strategy="broadcast").collect()}) == 20


def test_embedder_sees_bounded_batches(spark):
    import pyarrow as pa

    from tidepool.operators.embed import embed, letter_histogram

    from pyspark.accumulators import AccumulatorParam

    class Max(AccumulatorParam):
        def zero(self, v):
            return 0

        def addInPlace(self, a, b):
            return max(a, b)

    biggest = spark.sparkContext.accumulator(0, Max())

    def model(batch: pa.RecordBatch) -> pa.RecordBatch:
        biggest.add(batch.num_rows)
        return letter_histogram(batch)

    df = spark.range(0, 300, 1, 2).selectExpr("id", "concat('abc', id) AS text")
    out = embed(df, embedder=model, batch_rows=16).collect()
    assert len(out) == 300 and all(r.v is not None for r in out)
    assert biggest.value == 16


@pytest.mark.parametrize("strategy", ["broadcast", "grid"])
def test_top_k_with_a_third_of_the_index_identical(spark, strategy, monkeypatch):
    monkeypatch.setattr(S, "MAX_BLOCK_ROWS", 64)
    monkeypatch.setattr(S, "CELL_BYTES", 8 * 4 * 128)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 4))
    hot = np.array([1.0, 2.0, 3.0, 4.0])
    x[::3] = hot  # every third row is the same vector
    df = vecs(spark, [(int(i), [float(a) for a in r]) for i, r in enumerate(x)])
    q = vecs(spark, [(10_000, [1.0, 2.0, 3.0, 4.0])])
    got = [r.id for r in S.top_k(df, q, 7, strategy=strategy).orderBy("rank").collect()]
    assert got == [0, 3, 6, 9, 12, 15, 18]


def test_near_duplicates_with_a_non_positive_threshold_keeps_rows_without_candidates(spark):
    df = vecs(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])])
    new = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    got = {r.id: r.score for r in S.near_duplicates(df, new, 0.0).collect()}
    # id 1 has no earlier row (0.0); id 2 is orthogonal to 1 (0.0); id 3 is opposite
    # to 1 (-1) but orthogonal to 2 (0.0)
    assert got == {1: 0.0, 2: 0.0, 3: 0.0}
    hi = {r.id for r in S.near_duplicates(df, new, 0.5).collect()}
    assert hi == set()


@pytest.mark.parametrize("strategy", ["broadcast", "grid"])
def test_extreme_vectors_score_like_any_other_and_bad_ones_hide_nothing(spark, strategy):
    nan, inf = float("nan"), float("inf")
    idx = vecs(spark, [(1, [1.0, 0.0]), (2, [1e-200, 0.0]), (3, [0.0, 1e300]), (4, [nan, 1.0]), (5, [inf, 1.0]),
                       (6, [None, 1.0]), (7, [5e-324, 0.0])])
    q = vecs(spark, [(100, [1e-250, 0.0]), (101, [nan, 0.0])])
    got = S.top_k(idx, q, 9, strategy=strategy).orderBy("qid", "rank").collect()
    assert [(r.qid, r.id, r.score) for r in got] == [(100, 1, 1.0), (100, 2, 1.0), (100, 7, 1.0), (100, 3, 0.0)]
    best = {r.qid: r.score for r in S.max_similarity(idx, q, strategy=strategy).collect()}
    assert best == {100: 1.0, 101: 0.0}


@pytest.mark.parametrize("strategy", ["broadcast", "grid"])
@pytest.mark.parametrize("index, queries", [
    ([(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0])], [(9, [1.0, 0.0])]),
    ([(1, [1.0, 0.0])], [(8, [1.0, 0.0, 0.0]), (9, [1.0, 0.0])]),
    ([(1, [1.0, 0.0])], [(9, [1.0, 0.0, 0.0, 0.0])]),
])
def test_vectors_of_different_dimensions_raise(spark, strategy, index, queries):
    with pytest.raises(Exception, match="dimension"):
        S.top_k(vecs(spark, index), vecs(spark, queries), 2, strategy=strategy).collect()


def test_grid_has_several_cells_for_small_inputs(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 4))
    index = vecs(spark, [(i, [float(a) for a in r]) for i, r in enumerate(x)])
    queries = vecs(spark, [(i, [float(a) for a in r]) for i, r in enumerate(x + 1e-3)])
    seen = Counters(spark.sparkContext)
    got = S.max_similarity(index, queries, strategy="grid", counters=seen).collect()
    assert len(got) == 900 and all(r.score > 0.99 for r in got)
    assert seen.values()["cells"] > 4


def test_last_vector_by_order_wins(spark):
    recs = records_df(spark, [(1, "a", "", "b", "", None)])
    new = spark.createDataFrame([(1, [9.0, 0.0], 1), (1, [0.0, 1.0], 2)], "id long, v array<double>, seq int")
    r, v = C.save_embeddings(recs, vecs(spark, []), new, "seq")
    assert r.first().embedding == [0.0, 1.0]
    assert [tuple(x) for x in v.collect()] == [(1, [0.0, 1.0])]
    with pytest.raises(Exception, match="order column"):
        C.upsert_vectors(vecs(spark, []), new).collect()


def test_embedder_vectors_that_are_not_finite_fail(spark):
    import pyarrow as pa

    from tidepool.operators.embed import embed

    def broken(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([[float("nan"), 1.0]] * n, pa.list_(pa.float64())), pa.nulls(n, pa.string())],
            names=["id", "v", "error"])

    out = embed(spark.createDataFrame([(1, "x")], "id long, text string"), embedder=broken, dim=2).first()
    assert (out.v, out.error) == (None, "non_finite")
