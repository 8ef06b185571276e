"""Store snapshots, migration, backfill, changes, export round trip, streaming."""

from __future__ import annotations

import datetime as dt
import json
import os

import pytest
from conftest import records_df
from pyspark.sql import functions as F

from tidepool.operators import changes as C
from tidepool.operators.ids import number_lines
from tidepool.plans import jobs
from tidepool.schema import RECORD_SCHEMA
from tidepool.sources import store as S
from tidepool.sources.jsonl import ORDER_COLS, read_lines

AS_OF = dt.datetime(2024, 5, 6, 7, 8, 9)


def test_create_is_idempotent(spark, tmp_root):
    st = S.Store(spark, tmp_root + "/s")
    a = st.create(4)
    b = st.create(4)
    assert a.version == b.version == 0
    assert st.records().columns == RECORD_SCHEMA.fieldNames()
    assert len(st.records().columns) == 8 and st.records().count() == 0


def test_migration_adds_defaults_and_keeps_rows(spark):
    legacy = spark.createDataFrame(
        [(1, "q", "", "a", dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 1))],
        "id long, instruction string, input string, output string, created_at timestamp_ntz, updated_at timestamp_ntz",
    )
    m = S.migrate(legacy).first()
    assert (m.id, m.source, m.embedding) == (1, "", None)


def test_backfill_recreates_and_keeps(spark):
    recs = records_df(spark, [(1, "a", "", "b", "", [1.0, 0.0, 0.0, 0.0]),
                              (2, "c", "", "d", "", [0.0, 0.0, 0.0, 0.0])])
    empty = spark.createDataFrame([], "id long, v array<double>")
    assert [r.id for r in S.backfill_vectors(recs, empty).collect()] == [1]
    other = spark.createDataFrame([(1, [0.0, 1.0, 0.0, 0.0])], "id long, v array<double>")
    kept = S.backfill_vectors(recs, other).collect()
    assert [(r.id, r.v) for r in kept] == [(1, [0.0, 1.0, 0.0, 0.0])]


def test_open_store_backfills_and_publishes(spark, tmp_root):
    st = S.Store(spark, tmp_root + "/s")
    recs = records_df(spark, [(1, "a", "", "b", "", [1.0, 0.0])])
    st.publish(recs, spark.createDataFrame([], "id long, v array<double>"), 1, dim=2)
    jobs.open_store(st, 2)
    assert st.current().version == 1 and st.vectors().count() == 1
    jobs.open_store(st, 2)
    assert st.current().version == 1  # nothing to do, nothing published


def test_existing_keys_ignore_source(spark):
    recs = records_df(spark, [(1, "a", "", "b", "x", None), (2, "a", "", "b", "y", None)])
    from tidepool.operators.dedup import distinct_keys

    assert [tuple(r) for r in distinct_keys(recs).collect()] == [("a", "", "b")]
    assert distinct_keys(spark.createDataFrame([], RECORD_SCHEMA)).count() == 0


def test_update_delete(spark):
    recs = records_df(spark, [(1, "a", "", "b", "", [1.0]), (2, "c", "", "d", "", [1.0]), (3, "e", "", "f", "", None)])
    vec = spark.createDataFrame([(1, [1.0]), (2, [1.0])], "id long, v array<double>")
    ch = spark.createDataFrame(
        [(1, "update", "A", "", "B", "s"), (2, "update", " ", "", "x", ""), (9, "update", "x", "", "y", ""),
         (3, "delete", None, None, None, None), (1, "delete", None, None, None, None)],
        "id long, op string, instruction string, input string, output string, source string")
    r, v = C.update(recs, vec, ch.where("op = 'update'"), AS_OF)
    rows = {x.id: x for x in r.collect()}
    assert rows[1].instruction == "A" and rows[1].embedding is None and rows[1].updated_at == AS_OF
    assert rows[1].created_at == dt.datetime(2020, 1, 1)
    assert rows[2].instruction == "c"  # blank instruction refused
    assert sorted(x.id for x in v.collect()) == [2]
    r2, v2 = C.apply_changes(recs, vec, ch, AS_OF)
    assert sorted(x.id for x in r2.collect()) == [2]
    assert sorted(x.id for x in v2.collect()) == [2]


def test_export_roundtrip_reimports_as_duplicates(spark, tmp_root):
    recs = records_df(spark, [(1, "naïve café?", "", "one\ntwo", "menu", None)])
    path = tmp_root + "/export"
    assert jobs.export_jsonl(recs, path) == 1
    text = "".join(open(os.path.join(path, f), encoding="utf-8").read()
                   for f in sorted(os.listdir(path)) if f.startswith("part-"))
    obj = json.loads(text.strip())
    assert list(obj) == ["instruction", "input", "output", "source"] and obj["instruction"] == "naïve café?"
    st = S.Store(spark, tmp_root + "/s")
    st.publish(recs, spark.createDataFrame([], "id long, v array<double>"), 1, dim=26)
    rep = jobs.import_jsonl(st, path, AS_OF).first()
    assert (rep.added, rep.duplicate) == (0, 1)
    assert jobs.export_jsonl(spark.createDataFrame([], RECORD_SCHEMA), tmp_root + "/none") == 0


def test_bootstrap_missing_and_present(spark, tmp_root):
    rep = jobs.bootstrap_import(S.Store(spark, tmp_root + "/a"), tmp_root + "/missing.jsonl", AS_OF).first()
    assert rep.added == 0
    src = tmp_root + "/legacy.jsonl"
    with open(src, "w", encoding="utf-8") as f:
        f.write(json.dumps({"instruction": "a", "output": "b"}) + "\n")
        f.write(json.dumps({"instruction": "c", "output": "d"}) + "\n")
    st = S.Store(spark, tmp_root + "/b")
    assert jobs.bootstrap_import(st, src, AS_OF).first().added == 2
    assert jobs.bootstrap_import(st, src, AS_OF).first().added == 0  # store existed


def test_line_order_across_splits(spark, tmp_root):
    from tidepool.operators.ids import number_lines
    from tidepool.sources.jsonl import ORDER_COLS, read_lines

    d = tmp_root + "/many"
    os.makedirs(d)
    expected = []
    for fi in range(3):
        with open(f"{d}/f{fi}.jsonl", "w") as f:
            for k in range(3000):
                line = f"{fi}-{k}-" + "x" * (k % 7)
                f.write(line + "\n")
                expected.append(line)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = read_lines(spark, d)
        assert lines.rdd.getNumPartitions() > 10
        got = [r.line for r in number_lines(lines, list(ORDER_COLS)).orderBy("line_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == expected


def test_incremental_stream_equals_single_import(spark, tmp_root):
    from tidepool.streaming.incremental import import_stream, stamp_arrival

    lines = [json.dumps({"instruction": f"i{k % 9}", "output": f"o{k % 4}"}) for k in range(60)]
    for i in range(3):
        os.makedirs(f"{tmp_root}/in/{i}")
        with open(f"{tmp_root}/in/{i}/part.jsonl", "w") as f:
            f.write("\n".join(lines[i * 20:(i + 1) * 20]) + "\n")
    stamp_arrival(spark, [f"{tmp_root}/in/{i}" for i in range(3)])
    st = S.Store(spark, tmp_root + "/st")
    st.create(26)
    import_stream(st, f"{tmp_root}/in", f"{tmp_root}/ck", as_of=AS_OF, max_files_per_trigger=1)
    one = S.Store(spark, tmp_root + "/one")
    one.create(26)
    with open(tmp_root + "/all.jsonl", "w") as f:
        f.write("\n".join(lines) + "\n")
    jobs.import_jsonl(one, tmp_root + "/all.jsonl", AS_OF)
    cols = ["id", "instruction", "input", "output", "source"]
    a = sorted(tuple(r) for r in st.records().select(*cols).collect())
    b = sorted(tuple(r) for r in one.records().select(*cols).collect())
    assert a == b and list(st.current().batch.values()) == [2]
    assert st.records().where(F.col("embedding").isNotNull()).count() == len(a)
    # The ledger has each batch, and together they are the one import's report.
    ledger = st.ledger().orderBy("batch_id").collect()
    assert [(r.stream, r.batch_id) for r in ledger] == [(f"{tmp_root}/ck", i) for i in range(3)]
    counts = ("added", "duplicate", "invalid", "near_duplicate")
    whole = one.ledger().first()
    assert whole.stream == "" and whole.batch_id is None
    assert [sum(r[c] for r in ledger) for c in counts] == [whole[c] for c in counts]
    assert st.compact() and st.ledger().count() == 3


def test_import_appends_and_compacts(spark, tmp_root):
    recs = records_df(spark, [(1, "a", "", "b", "", None)])
    st = S.Store(spark, tmp_root + "/s")
    st.publish(recs, spark.createDataFrame([], "id long, v array<double>"), 1, dim=26)
    src = tmp_root + "/in.jsonl"
    with open(src, "w") as f:
        f.write(json.dumps({"instruction": "c", "output": "d"}) + "\n")
    jobs.import_jsonl(st, src, AS_OF)
    snap = st.current()
    assert len(snap.records) == 2 and snap.high_water == 2
    assert sorted(r.id for r in st.records().collect()) == [1, 2]
    assert st.key_index().count() == 2
    st.compact()
    assert len(st.current().records) == 1
    assert sorted(r.id for r in st.records().collect()) == [1, 2]


def test_replayed_stream_batch_is_skipped(spark, tmp_root):
    from tidepool.streaming.incremental import import_stream

    os.makedirs(f"{tmp_root}/in/0")
    with open(f"{tmp_root}/in/0/a.jsonl", "w") as f:
        f.write(json.dumps({"instruction": "a", "output": "b"}) + "\n")
    st = S.Store(spark, tmp_root + "/st")
    st.create(26)
    snap = st.current()
    # Pretend batch 0 was already published (a replay after a failure).
    st._point(S.Snapshot(snap.version + 1, snap.high_water, {f"{tmp_root}/ck": 0}, snap.dim, snap.records, snap.vectors,
                         snap.ranges))
    import_stream(st, f"{tmp_root}/in", f"{tmp_root}/ck", as_of=AS_OF)
    assert st.records().count() == 0
    # Another checkpoint is another stream: its batch 0 is new.
    import_stream(st, f"{tmp_root}/in", f"{tmp_root}/ck2", as_of=AS_OF)
    assert st.records().count() == 1


def test_update_trims_trailing_newlines_when_asked(spark):
    recs = records_df(spark, [(1, "a", "", "b", "", None)])
    vec = spark.createDataFrame([], "id long, v array<double>")
    ch = spark.createDataFrame([(1, "q\n\n", "", "x\n", "s\n")], "id long, instruction string, input string, output string, source string")
    r, _ = C.update(recs, vec, ch, AS_OF, trim_newlines=True)
    row = r.first()
    assert (row.instruction, row.output, row.source) == ("q", "x", "s")
    r, _ = C.update(recs, vec, ch, AS_OF)
    assert r.first().instruction == "q\n\n"


def test_lookup_small_and_large_id_sets(spark):
    recs = records_df(spark, [(i, "a", "", "b", "", None) for i in range(1, 30)])
    ids = spark.createDataFrame([(3,), (5,), (99,), (5,)], "id long")
    assert sorted(r.id for r in S.lookup(recs, ids).collect()) == [3, 5]
    assert S.lookup(recs, spark.createDataFrame([], "id long")).count() == 0


def test_store_level_jobs_and_cli(spark, tmp_root, capsys):
    from tidepool.__main__ import main

    src = tmp_root + "/in.jsonl"
    with open(src, "w") as f:
        f.write(json.dumps({"instruction": "apple pie", "output": "bake"}) + "\n")
        f.write(json.dumps({"instruction": "zebra", "output": "stripes"}) + "\n")
    store = tmp_root + "/st"
    assert main(["import", store, src]) == 0
    assert "'added': 2" in capsys.readouterr().out
    assert main(["search", store, "apple"]) == 0
    out = capsys.readouterr().out.strip().splitlines()
    assert out[0].split()[0] == "1" and "id=1" in out[0]
    ch = tmp_root + "/ch.jsonl"
    with open(ch, "w") as f:
        f.write(json.dumps({"id": 2, "op": "delete"}) + "\n")
        for text in ("zzz first", "apple tart\n"):  # the later line wins
            f.write(json.dumps({"id": 1, "op": "update", "instruction": text, "input": "", "output": "bake", "source": ""}) + "\n")
        for text in ("pear pie", "apple tart", " "):  # no duplicate check; a blank one is refused
            f.write(json.dumps({"op": "insert", "instruction": text, "input": "", "output": "bake"}) + "\n")
    assert main(["change", store, ch]) == 0
    st = S.Store(spark, store)
    rows = st.records().orderBy("id").collect()
    assert [(r.id, r.instruction, r.source, r.embedding) for r in rows] == [
        (1, "apple tart", "", None), (3, "pear pie", "", None), (4, "apple tart", "", None)]
    assert st.vectors().count() == 0
    rep = jobs.embed_store(st).first()
    assert (rep.succeeded, rep.total) == (3, 3) and st.vectors().count() == 3
    capsys.readouterr()
    assert main(["ledger", store]) == 0 and "'added': 2" in capsys.readouterr().out
    assert main(["export", store, tmp_root + "/one.jsonl", "--one-file"]) == 0 and os.path.isfile(tmp_root + "/one.jsonl")
    assert main(["embed", store, "--embedder", "tidepool.operators.embed:letter_histogram"]) == 0
    assert main(["export", store, tmp_root + "/out"]) == 0
    assert jobs.export_store(st, tmp_root + "/out2") == 3
    before = st.current()
    bad = spark.createDataFrame([(1, "upsert", "x", "", "y", "")],
                                "id long, op string, instruction string, input string, output string, source string")
    with pytest.raises(ValueError, match="unknown op"):
        jobs.change_store(st, bad, AS_OF)
    assert st.current() == before


def test_the_store_dimension_decides(spark, tmp_root):
    st = S.Store(spark, tmp_root + "/four")
    st.create(4)
    src = tmp_root + "/in.jsonl"
    with open(src, "w") as f:
        f.write(json.dumps({"instruction": "apple pie", "output": "bake"}) + "\n")
    assert jobs.import_jsonl(st, src, AS_OF).first().added == 1  # its 26 letters are no vector of this store
    assert st.vectors().count() == 0 and st.records().first().embedding is None
    with pytest.raises(ValueError, match="dimension 4"):
        jobs.search_store(st, spark.createDataFrame([(0, "apple")], "qid long, text string"))
    wrong = spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<double>")
    with pytest.raises(Exception, match="not of dimension 4"):
        st.append(st.records().limit(0), wrong, 1)
    assert st.vectors().count() == 0


def test_bootstrap_hides_only_what_cannot_be_read(spark, tmp_root, monkeypatch):
    import os

    src = tmp_root + "/boot.jsonl"
    with open(src, "w") as f:
        f.write(json.dumps({"instruction": "apple pie", "output": "bake"}) + "\n")

    def full(*args, **kw):
        raise RuntimeError("java.io.IOException: No space left on device")

    monkeypatch.setattr(S.Store, "append", full)
    with pytest.raises(RuntimeError, match="No space"):
        jobs.bootstrap_import(S.Store(spark, tmp_root + "/b1"), src, AS_OF)
    assert os.path.exists(src)
    assert jobs.bootstrap_import(S.Store(spark, tmp_root + "/b2"), tmp_root + "/none", AS_OF).first().added == 0


def test_changes_rewrite_only_touched_segments(spark, tmp_root):
    st = S.Store(spark, tmp_root + "/seg")
    st.create(26)
    for part in range(3):
        src = f"{tmp_root}/p{part}.jsonl"
        with open(src, "w") as f:
            for k in range(4):
                f.write(json.dumps({"instruction": f"q{part}-{k}", "output": "a"}) + "\n")
        jobs.import_jsonl(st, src, AS_OF)
    before = st.current()
    assert before.ranges[1:] == [[1, 4], [5, 8], [9, 12]]
    ch = spark.createDataFrame([(6, "delete", None, None, None, None)],
                               "id long, op string, instruction string, input string, output string, source string")
    jobs.change_store(st, ch, AS_OF)
    after = st.current()
    changed = [i for i in range(len(after.records)) if after.records[i] != before.records[i]]
    assert changed == [2]
    assert sorted(r.id for r in st.records().collect()) == [1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12]
    assert sorted(r.id for r in st.vectors().collect()) == [1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12]


def test_import_against_store_index(spark, tmp_root, monkeypatch):
    recs = records_df(spark, [(i, f"q{i}", "", "a", "", None) for i in range(1, 21)])
    for limit in (1 << 18, 4):
        monkeypatch.setattr(S, "BLOCK_IDS", limit)
        st = S.Store(spark, f"{tmp_root}/s{limit}")
        st.publish(recs, spark.createDataFrame([], "id long, v array<double>"), 20, dim=26)
        src = f"{tmp_root}/in{limit}.jsonl"
        with open(src, "w") as f:
            for k in (3, 7, 25, 3):
                f.write(json.dumps({"instruction": f"q{k}", "output": "a"}) + "\n")
        rep = jobs.import_jsonl(st, src, AS_OF).first()
        assert (rep.added, rep.duplicate) == (1, 3)
        assert sorted(r.id for r in st.records().collect()) == list(range(1, 22))


def test_line_breaks_and_bad_utf8(spark, tmp_root):
    from tidepool.operators.ids import number_lines
    from tidepool.sources.jsonl import ORDER_COLS, classify, non_blank, read_lines

    path = tmp_root + "/mixed.jsonl"
    good = json.dumps({"instruction": "a b", "output": "c"}, ensure_ascii=False).encode()
    with open(path, "wb") as f:
        f.write(b"l1\r\nl2\rl3\n" + good + b"\n" + b'{"instruction":"\xff","output":"x"}' + b"\n")
    lines = number_lines(read_lines(spark, path), list(ORDER_COLS)).orderBy("line_no").collect()
    assert [r.line for r in lines[:3]] == ["l1", "l2", "l3"]
    assert len(lines) == 5  # U+2028 does not break a line
    got = {r.line_no: r.status for r in classify(non_blank(number_lines(read_lines(spark, path), list(ORDER_COLS)))).collect()}
    assert got[3] == "valid" and got[4] == "bad_utf8" and got[0] == "malformed"


def test_open_store_bootstraps_only_once(spark, tmp_root):
    src = tmp_root + "/legacy.jsonl"
    with open(src, "w") as f:
        f.write(json.dumps({"instruction": "a", "output": "b"}) + "\n")
    st = S.Store(spark, tmp_root + "/o")
    jobs.open_store(st, 26, bootstrap_path=src, as_of=AS_OF)
    assert st.records().count() == 1
    jobs.open_store(st, 26, bootstrap_path=src, as_of=AS_OF)
    assert st.records().count() == 1


def test_version_files_are_never_overwritten(spark, tmp_root):
    import pytest

    st = S.Store(spark, tmp_root + "/v")
    snap = st.create(4)
    with pytest.raises(RuntimeError):
        st._point(snap)
    assert st.current().version == 0


def test_ids_are_not_reused_after_delete(spark, tmp_root):
    st = S.Store(spark, tmp_root + "/ids")
    st.create(26)
    a, b = tmp_root + "/a.jsonl", tmp_root + "/b.jsonl"
    with open(a, "w") as f:
        for k in range(3):
            f.write(json.dumps({"instruction": f"x{k}", "output": "y"}) + "\n")
    with open(b, "w") as f:
        f.write(json.dumps({"instruction": "later", "output": "y"}) + "\n")
    jobs.import_jsonl(st, a, AS_OF)
    ch = spark.createDataFrame([(3, "delete", None, None, None, None)],
                               "id long, op string, instruction string, input string, output string, source string")
    jobs.change_store(st, ch, AS_OF)
    jobs.import_jsonl(st, b, AS_OF)
    assert sorted(r.id for r in st.records().collect()) == [1, 2, 4]


def test_legacy_store_folder_is_migrated_on_read(spark, tmp_root):
    root = tmp_root + "/legacy"
    legacy = spark.createDataFrame(
        [(1, "q", "", "a", dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 1))],
        "id long, instruction string, input string, output string, created_at timestamp_ntz, updated_at timestamp_ntz")
    legacy.write.parquet(root + "/records/v=0")
    spark.createDataFrame([], "id long, v array<double>").write.parquet(root + "/vectors/v=0")
    st = S.Store(spark, root)
    st._point(S.Snapshot(0, 1, -1, 4, ["records/v=0"], ["vectors/v=0"], [[0, 1]]))
    row = st.records().first()
    assert (row.id, row.source, row.embedding) == (1, "", None)
    assert st.records().columns == RECORD_SCHEMA.fieldNames()
    src = tmp_root + "/more.jsonl"
    with open(src, "w") as f:
        f.write(json.dumps({"instruction": "q", "input": "", "output": "a"}) + "\n")
        f.write(json.dumps({"instruction": "new", "output": "b"}) + "\n")
    rep = jobs.import_jsonl(st, src, AS_OF).first()
    assert (rep.added, rep.duplicate) == (1, 1)
    assert sorted(r.id for r in st.records().collect()) == [1, 2]


def test_append_compacts_at_the_folder_limit(spark, tmp_root, monkeypatch):
    monkeypatch.setattr(S, "MAX_FOLDERS", 3)
    st = S.Store(spark, tmp_root + "/c")
    st.create(26)
    for k in range(4):
        src = f"{tmp_root}/c{k}.jsonl"
        with open(src, "w") as f:
            f.write(json.dumps({"instruction": f"q{k}", "output": "a"}) + "\n")
        jobs.import_jsonl(st, src, AS_OF)
        assert len(st.current().records) <= 3
    assert sorted(r.id for r in st.records().collect()) == [1, 2, 3, 4]


def test_import_timestamp_has_second_precision(spark, tmp_root):
    st = S.Store(spark, tmp_root + "/ts")
    st.create(26)
    src = tmp_root + "/t.jsonl"
    with open(src, "w") as f:
        f.write(json.dumps({"instruction": "a", "output": "b"}) + "\n")
    jobs.import_jsonl(st, src)  # as_of defaults to now
    row = st.records().first()
    assert row.created_at == row.updated_at and row.created_at.microsecond == 0
    text = st.records().select(F.col("created_at").cast("string").alias("t")).first().t
    assert dt.datetime.fromisoformat(text) == row.created_at and "." not in text


def test_export_counts_each_row_once_and_keeps_id_order(spark, tmp_root):
    recs = records_df(spark, [(i, f"q{i}", "", "a", "", None) for i in range(500, 0, -1)]).repartition(7)
    path = tmp_root + "/ordered"
    assert jobs.export_jsonl(recs, path) == 500
    lines = number_lines(read_lines(spark, path), list(ORDER_COLS))
    got = jobs.line_status(lines, ["line_no"]).orderBy("line_no").collect()
    assert [r.instruction for r in got] == [f"q{i}" for i in range(1, 501)]


def test_legacy_store_with_text_embeddings(spark, tmp_root):
    old = spark.createDataFrame([(1, "a", "", "b", "[0.5, 1.0]"), (2, "c", "", "d", ""), (3, "e", "", "f", None)],
                                "id long, instruction string, input string, output string, embedding string")
    ts = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    old = old.withColumns({"created_at": ts, "updated_at": ts})
    got = {r.id: r.embedding for r in S.migrate(old).collect()}
    assert got == {1: [0.5, 1.0], 2: None, 3: None}
    root = tmp_root + "/legacy"
    old.write.parquet(f"{root}/records/v=0")
    spark.createDataFrame([], "id long, v array<double>").write.parquet(f"{root}/vectors/v=0")
    S._create_text(spark, f"{root}/_versions/{0:020d}.json", json.dumps(
        {"version": 0, "high_water": 3, "batch": {}, "dim": 2, "records": ["records/v=0"], "vectors": ["vectors/v=0"]}))
    st = jobs.open_store(S.Store(spark, root), 2)
    assert [(r.id, r.v) for r in st.vectors().collect()] == [(1, [0.5, 1.0])]
    assert st.key_index().count() == 3 and sorted(r.id for r in st.pending().collect()) == [2, 3]
    assert [r.id for r in st.lookup(spark.createDataFrame([(2,), (9,)], "id long")).collect()] == [2]
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        S.migrate(old.withColumn("embedding", F.lit("[1, oops"))).collect()


def test_change_set_is_one_version(spark, tmp_root):
    recs = records_df(spark, [(i, f"q{i}", "", "a", "", None) for i in range(1, 6)])
    st = S.Store(spark, tmp_root + "/s")
    st.publish(recs, spark.createDataFrame([], "id long, v array<double>"), 5, dim=26)
    before = st.current().version
    ch = spark.createDataFrame([(1, 2, "update", "new", "", "x", ""), (2, 3, "delete", None, None, None, None), (3, None, "insert", "own", "", "y", "")],
                               "seq int, id long, op string, instruction string, input string, output string, source string")
    jobs.change_store(st, ch, AS_OF, "seq")
    assert st.current().version == before + 1
    assert sorted((r.id, r.instruction) for r in st.records().collect()) == [(1, "q1"), (2, "new"), (4, "q4"), (5, "q5"), (6, "own")]
    jobs.change_store(st, ch.where("op = 'insert'"), AS_OF, "seq")
    assert st.current().version == before + 2 and st.current().high_water == 7


def test_export_keeps_the_old_one_when_it_fails(spark, tmp_root):
    recs = records_df(spark, [(i, f"q{i}", "", "a", "", None) for i in range(1, 300)])
    path = tmp_root + "/out"
    assert jobs.export_jsonl(recs, path) == 299
    old = spark.read.text(path).count()
    bad = recs.withColumn("output", F.when(F.col("id") == 77, F.raise_error(F.lit("boom"))).otherwise(F.col("output")))
    with pytest.raises(Exception, match="boom"):
        jobs.export_jsonl(bad, path)
    assert spark.read.text(path).count() == old
    assert sorted(os.listdir(tmp_root)) == ["out"]
    assert jobs.export_jsonl(recs.limit(0), path) == 0 and spark.read.text(path).count() == old


def test_export_to_one_file(spark, tmp_root):
    recs = records_df(spark, [(i, f"q{i}", "", "naïve", "", None) for i in range(500, 0, -1)])
    path = tmp_root + "/all.jsonl"
    for _ in range(2):  # a second one replaces the first
        assert jobs.export_jsonl(recs, path, one_file=True) == 500
    assert os.path.isfile(path)
    with open(path, encoding="utf-8") as f:
        assert [json.loads(x)["instruction"] for x in f] == [f"q{i}" for i in range(1, 501)]
    assert sorted(x for x in os.listdir(tmp_root) if not x.startswith(".")) == ["all.jsonl"]


def test_stream_takes_the_stores_dimension(spark, tmp_root):
    import pyarrow as pa

    from tidepool.streaming.incremental import import_stream

    def three(batch):
        v = pa.array([[1.0, 2.0, float(i)] for i in batch.column(0).to_pylist()], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([batch.column(0), v, pa.nulls(batch.num_rows, pa.string())], names=["id", "v", "error"])

    os.makedirs(f"{tmp_root}/in")
    with open(f"{tmp_root}/in/a.jsonl", "w") as f:
        f.write(json.dumps({"instruction": "a", "output": "b"}) + "\n")
    st = S.Store(spark, tmp_root + "/st")
    st.create(3)
    import_stream(st, f"{tmp_root}/in", f"{tmp_root}/ck", as_of=AS_OF, embedder=three)
    assert [len(r.v) for r in st.vectors().collect()] == [3]


def test_jobs_release_what_they_staged(spark, tmp_root):
    from tidepool.session import checkpoint_root

    staged = os.path.join(checkpoint_root(spark).replace("file:", ""), "staged")
    before = set(os.listdir(staged)) if os.path.isdir(staged) else set()
    src = tmp_root + "/in.jsonl"
    with open(src, "w") as f:
        f.write(json.dumps({"instruction": "apple", "output": "pie"}) + "\n")
    st = S.Store(spark, tmp_root + "/s")
    st.create(26)
    assert jobs.import_jsonl(st, src, AS_OF).first().added == 1
    jobs.embed_store(st)
    assert set(os.listdir(staged)) == before
