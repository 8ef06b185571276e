"""Physical-plan properties that matter at scale."""

from __future__ import annotations

import re

from conftest import records_df
from pyspark.sql import functions as F

from tidepool.operators import similarity as S
from tidepool.operators.dedup import anti_join_keys, key_hash, key_hits, prefix_of
from tidepool.session import stage
from tidepool.sources import store as ST


def plan_of(df) -> str:
    spark = df.sparkSession
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")  # untruncated scan details
    try:
        df.write.format("noop").mode("overwrite").save()
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def vecs(spark, n, dim=8, offset=0):
    return spark.range(offset, offset + n).select(
        F.col("id"), F.array(*[((F.col("id") * (i + 3)) % 7 + 1).cast("double") for i in range(dim)]).alias("v"))


def test_similarity_plans_have_no_pair_joins(spark, monkeypatch):
    idx, q = vecs(spark, 400), vecs(spark, 50, offset=1000)
    for strategy in ("broadcast", "grid"):
        if strategy == "grid":
            monkeypatch.setattr(S, "CELL_BYTES", 8 * 8 * 64)
        p = plan_of(S.top_k(idx, q, 5, strategy=strategy))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
        if strategy == "grid":
            assert "FlatMapCoGroupsInArrow" in p
        else:
            assert "MapInArrow" in p and "Exchange" in p  # only the final top-k merge shuffles


def scanned_files(df) -> int:
    """Files that the executed plan's scans read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.nodeName().startswith("Adaptive") else plan
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if "Scan parquet" in node.nodeName():
            total += node.metrics().apply("numFiles").value()
        node = node.plan() if node.nodeName().endswith("QueryStage") else node
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())] if not node.nodeName().endswith("QueryStage") else []
    return total


def test_store_side_of_duplicate_check_is_not_shuffled(spark, tmp_root):
    recs = records_df(spark, [(i, f"q{i}", "", "a", "", None) for i in range(1, 2000)])
    st = ST.Store(spark, tmp_root + "/s")
    st.publish(recs, spark.createDataFrame([], "id long, v array<double>"), 1999, dim=4)
    rows = spark.createDataFrame([("q5", "", "a", 1), ("new", "", "b", 2)],
                                 "instruction string, input string, output string, line_no long")
    new = anti_join_keys(rows, st.records(), st.key_index(), st.lookup)
    assert [r.instruction for r in new.collect()] == ["new"]
    hashed = stage(rows.withColumn("_h", key_hash()).withColumn("_prefix", prefix_of("_h")), "test-keys")
    hits = key_hits(st.key_index(), hashed)
    p = plan_of(hits)
    # The stored hashes are read alone and probed against a broadcast of the new hashes; prefixes without one are not read.
    assert re.search(r"BroadcastHashJoin \[_prefix#\d+, _h#\d+L\], \[_prefix#\d+, _h#\d+L\], LeftSemi, BuildRight", p)
    assert "dynamicpruning" in p
    assert scanned_files(hits) <= 2 + hashed.rdd.getNumPartitions() < st.key_index().inputFiles().__len__()


def test_lookup_reads_the_wanted_blocks_only(spark, tmp_root, monkeypatch):
    monkeypatch.setattr(ST, "BLOCK_IDS", 100)
    recs = records_df(spark, [(i, "a", "", "b", "", None) for i in range(1, 3000)])
    st = ST.Store(spark, tmp_root + "/l")
    st.publish(recs, spark.createDataFrame([], "id long, v array<double>"), 2999, dim=4)
    files = len(st.records().inputFiles())
    for wanted in ([7, 9], list(range(1, 3000, 7))):  # one plan at every number of ids
        ids = stage(spark.createDataFrame([(i,) for i in wanted], "id long"), "test-ids")
        df = st.lookup(ids)
        p = plan_of(df)
        assert "dynamicpruning" in p and "LeftSemi" in p and "In(id" not in p
        assert sorted(r.id for r in df.collect()) == wanted
    few = stage(spark.createDataFrame([(7,), (9,)], "id long"), "test-ids")
    assert files >= 30 and scanned_files(st.lookup(few)) <= 2 + few.rdd.getNumPartitions()


def test_report_of_an_import_reads_no_lines(spark):
    from conftest import empty_store, lines_df

    from tidepool.plans import jobs

    lines = lines_df(spark, ['{"instruction":"a","output":"b"}', '{"instruction":"a","output":"b"}', "nope"])
    import datetime as dt

    res = jobs.import_lines(lines, *empty_store(spark), 0, dt.datetime(2021, 1, 1), order_cols=["line_no"])
    assert "InMemoryTableScan" not in plan_of(res.report)
    assert tuple(res.report.first()) == (1, 1, 1, 0)
    res.release()


def test_first_wins_aggregates_before_the_shuffle(spark):
    from tidepool.operators.dedup import first_wins

    hot = spark.range(0, 3000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id) END AS instruction",
        "'' AS input", "'o' AS output", "'s' AS source", "id AS line_no")
    df = first_wins(hot, ["line_no"])
    assert df.where("instruction = 'hot'").first().line_no == 0
    p = plan_of(df)
    # A partial aggregate runs in every map task, before the exchange on the key.
    assert re.search(r"(Sort|Hash)Aggregate\(key=\[.*\], functions=\[partial_min", p)


def test_pending_scan_does_not_read_embeddings(spark, tmp_root):
    recs = records_df(spark, [(1, "a", "", "b", "", [1.0, 0.0]), (2, "c", "", "d", "", None)])
    st = ST.Store(spark, tmp_root + "/p")
    st.publish(recs, spark.createDataFrame([], "id long, v array<double>"), 2, dim=2)
    df = st.pending()
    assert [r.id for r in df.collect()] == [2]
    p = plan_of(df)
    assert "embedding" not in p.split("ReadSchema:")[1].splitlines()[0]
    assert "EqualTo(_pending,true)" in p


def test_a_filter_on_the_status_does_not_repeat_the_parse(spark):
    from tidepool.plans import jobs
    from tidepool.sources.jsonl import classify

    lines = spark.createDataFrame([(0, '{"instruction":"a","output":"b"}'), (1, "{"), (2, '{"instruction":"a","output":" "}')], "line_no long, line string")
    parses = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("from_json")
    status = jobs.line_status(lines.join(lines.select("line_no"), "line_no"), ["line_no"])
    assert parses(status.where("status = 'valid'")) <= parses(status)
    assert {r.line_no: r.status for r in classify(lines).collect()} == {0: "valid", 1: "malformed", 2: "blank_required"}
    assert [r.instruction for r in status.where("status = 'valid'").collect()] == ["a"]
