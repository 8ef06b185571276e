"""Import job: literal cases plus a property test
against a sequential model of the import rules."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F
from conftest import empty_store, failing_embedder, lines_df, records_df, table_embedder

from tidepool.plans import jobs
from tidepool.sources.jsonl import classify, non_blank

AS_OF = dt.datetime(2024, 1, 2, 3, 4, 5)


def j(**kw):
    return json.dumps(kw, ensure_ascii=False)


def run(spark, lines, records=None, vectors=None, hw=0, **kw):
    if records is None:
        records, vectors = empty_store(spark)
    res = jobs.import_lines(lines_df(spark, lines), records, vectors, hw, AS_OF, order_cols=["line_no"], **kw)
    return res, res.report.first().asDict()


BREAD = dict(instruction="Knead bread dough", input="500 g flour", output="Ten minutes, until smooth.")
STARS = dict(instruction="Näme the brightest star", output="Sirius")


def kept_in(spark, lines, stored=()):
    """Import the lines over the stored records: the sources of the accepted rows by id, and the report."""
    records = records_df(spark, [(i, r["instruction"], r.get("input", ""), r["output"], r.get("source", ""), None)
                                 for i, r in enumerate(stored, 1)])
    vectors = spark.createDataFrame([], "id long, v array<double>")
    res, rep = run(spark, [line if isinstance(line, str) else j(**line) for line in lines], records, vectors, len(stored))
    return {r.id: r.source for r in res.added.collect()}, (rep["added"], rep["duplicate"], rep["invalid"])


def test_fields_of_accepted_rows(spark):
    res, rep = run(spark, [j(**STARS), j(**BREAD, source="kitchen")])
    rows = {r.id: (r.instruction, r.input, r.output, r.source) for r in res.added.collect()}
    assert rows == {1: (*[STARS[k] if k in STARS else "" for k in ("instruction", "input", "output")], ""),
                    2: (*BREAD.values(), "kitchen")}
    assert rep == {"added": 2, "duplicate": 0, "invalid": 0, "near_duplicate": 0}


def test_the_triple_decides_and_the_first_line_wins(spark):
    other = {**STARS, "output": "Canopus comes second"}
    lines = [dict(BREAD, source="b"), dict(STARS, source="s1"), dict(STARS, source="s2"), other, dict(STARS, source="s1")]
    assert kept_in(spark, lines) == ({1: "b", 2: "s1", 3: ""}, (3, 2, 0))
    # A stored triple counts as seen, whatever its source.
    assert kept_in(spark, lines, [dict(BREAD, source="library"), STARS]) == ({3: ""}, (1, 4, 0))


def test_one_bad_line_of_each_kind_stops_no_other(spark):
    bad = ['{"instruction": "half', '"a text"', dict(STARS, instruction=" "), dict(BREAD, output="\t"), dict(BREAD, output=7)]
    assert kept_in(spark, [*bad, STARS]) == ({1: ""}, (1, 0, len(bad)))


EXTRA = [
    ('{"instruction":"a","input":null,"output":"b"}', "bad_type"),
    ('{"instruction":"a","output":"b"} trailing', "malformed"),
    ('{"instruction":"a","output":"b"}]', "malformed"),
    ('{"instruction":"a","output":"b"}}', "malformed"),
    ('{"instruction":"a","output":"b"},{}', "malformed"),
    ("{'instruction':'a','output':'b'}", "malformed"),
    ('{"instruction":"a","instruction":"z","output":"b"}', "valid"),
    ('{"instruction":"a","output":"b","x":NaN}', "valid"),
    ('{"instruction":"a","output":"b","x":+INF}', "malformed"),
    ('{"Instruction":"A","output":"b"}', "blank_required"),
    ('{"instruction":"　","output":"b"}', "blank_required"),
    ("{}", "blank_required"),
    ("42", "not_object"),
    ("null", "not_object"),
]


@pytest.mark.parametrize("line,status", EXTRA)
def test_line_cases(spark, line, status):
    got = classify(non_blank(lines_df(spark, [line]))).first()
    assert got.status == status
    if line.count('"instruction"') == 2:
        assert got.instruction == "z"


def test_blank_lines_not_counted(spark):
    _, rep = run(spark, ["   ", "", "　", j(instruction="a", output="b")])
    assert rep == {"added": 1, "duplicate": 0, "invalid": 0, "near_duplicate": 0}


def test_missing_source_is_empty(spark):
    res, _ = run(spark, [j(instruction="a", output="b")])
    assert res.added.first().source == ""


def test_embedder_down(spark):
    res, rep = run(spark, [j(instruction="a", output="b")], embedder=failing_embedder)
    assert rep["added"] == 1 and rep["near_duplicate"] == 0
    assert res.records.where("embedding IS NOT NULL").count() == 0


def _near_case(spark, new_vec):
    recs = records_df(spark, [(1, "old", "", "x", "", [1.0, 0.0, 0.0, 0.0])])
    vecs = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "id long, v array<double>")
    emb = table_embedder({"new": new_vec}, 4)
    return run(spark, [j(instruction="new", output="y")], recs, vecs, hw=1, embedder=emb, dim=4)


def test_near_duplicate_high_and_low(spark):
    _, hi = _near_case(spark, [1.0, 0.0, 0.0, 0.0])
    _, lo = _near_case(spark, [0.0, 1.0, 0.0, 0.0])
    assert (hi["added"], hi["near_duplicate"]) == (1, 1)
    assert (lo["added"], lo["near_duplicate"]) == (1, 0)


def test_import_stores_vector(spark):
    emb = table_embedder({"q": [0.5, 0.5, 0.0, 0.0]}, 4)
    res, _ = run(spark, [j(instruction="q", output="a")], embedder=emb, dim=4)
    assert res.records.first().embedding == [0.5, 0.5, 0.0, 0.0]
    assert [tuple(r) for r in res.vectors.collect()] == [(1, [0.5, 0.5, 0.0, 0.0])]


def test_ids_continue_from_high_water(spark):
    recs = records_df(spark, [(3, "a", "", "b", "", None)])
    vecs = spark.createDataFrame([], "id long, v array<double>")
    res, _ = run(spark, [j(instruction="c", output="d"), j(instruction="e", output="f")], recs, vecs, hw=9)
    assert sorted(r.id for r in res.added.collect()) == [10, 11]


# --- property test: set-based plan == sequential rules ------------------------

FIELD_NAMES = ("instruction", "input", "output", "source")


def line_kind(text):
    """Specification of one line: None (blank), 'invalid', or the four strings."""
    body = text.strip()
    if not body:
        return None
    try:
        value = json.loads(body)
    except json.JSONDecodeError:
        return "invalid"
    if type(value) is not dict:
        return "invalid"
    fields = tuple(value.get(name, "") for name in FIELD_NAMES)
    if any(type(f) is not str for f in fields):
        return "invalid"
    return fields if fields[0].strip() and fields[2].strip() else "invalid"


def cosine(a, b):
    na, nb = sum(x * x for x in a) ** 0.5, sum(x * x for x in b) ** 0.5
    return sum(x * y for x, y in zip(a, b)) / (na * nb) if na and nb else None


def sequential(lines, store, vec_of, threshold=0.93, hw=0):
    """Reference model of the import rules, evaluated one line at a time."""
    kinds = [k for k in map(line_kind, lines) if k is not None]
    seen = {row[:3] for row in store}
    pool = [v for v in (vec_of(r[0], r[1]) for r in store) if any(v)]
    accepted, near = [], 0
    for fields in (k for k in kinds if k != "invalid"):
        if fields[:3] in seen:
            continue
        seen.add(fields[:3])
        vec = vec_of(fields[0], fields[1])
        scores = [c for c in (cosine(vec, other) for other in pool) if c is not None]
        near += bool(scores) and max(scores) >= threshold
        if any(vec):
            pool.append(vec)
        accepted.append((hw + 1 + len(accepted), *fields))
    n_valid = sum(1 for k in kinds if k != "invalid")
    report = {"added": len(accepted), "duplicate": n_valid - len(accepted),
              "invalid": len(kinds) - n_valid, "near_duplicate": int(near)}
    return report, accepted


def letters(a, b):
    t = (a.strip() + b.strip()).lower()
    return [float(t.count(c)) for c in "abcdefghijklmnopqrstuvwxyz"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_sequential_model(spark, seed):
    rng = random.Random(seed)
    words = ["ab", "ba", "abc", "zz", "", " ", "q", "cab", "zzz a"]
    lines = []
    for _ in range(120):
        r = rng.random()
        if r < 0.08:
            lines.append(rng.choice(["{bad", "[1]", "  ", "null", '{"instruction":1}']))
        else:
            d = {"instruction": rng.choice(words), "output": rng.choice(words)}
            if rng.random() < 0.7:
                d["input"] = rng.choice(words)
            if rng.random() < 0.5:
                d["source"] = rng.choice(["s1", "s2"])
            lines.append(json.dumps(d))
    store = [("ab", "", "ba", ""), ("zz", "q", "abc", "s")]
    recs = records_df(spark, [(i, a, b, c, d, letters(a, b)) for i, (a, b, c, d) in enumerate(store, start=1)])
    from pyspark.sql import functions as F

    from tidepool.functions.vector import nonzero
    vecs = recs.where(nonzero("embedding")).select("id", F.col("embedding").alias("v"))
    res, rep = run(spark, lines, recs, vecs, hw=len(store))
    exp_rep, exp_rows = sequential(lines, store, letters, hw=len(store))
    assert rep == exp_rep
    got = sorted(tuple(r) for r in res.added.select("id", "instruction", "input", "output", "source").collect())
    assert got == sorted(exp_rows)


def test_partitioning_does_not_change_result(spark):
    lines = [json.dumps({"instruction": f"i{k % 37}", "output": f"o{k % 11}"}) for k in range(400)]
    base = None
    for parts in ("1", "3", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        res, rep = run(spark, lines)
        got = sorted(tuple(r) for r in res.added.select("id", "line_no").collect())
        if base is None:
            base = (rep, got)
        assert (rep, got) == base
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_embed_pending_modes(spark):
    from tidepool.operators.embed import FAIL_STOP, flaky, letter_histogram

    recs = records_df(spark, [(i, f"q{i}", "", "a", "", None) for i in range(1, 9)])
    vecs = spark.createDataFrame([], "id long, v array<double>")
    emb = flaky(letter_histogram, 4)
    r, v, rep, _ = jobs.embed_pending(recs, vecs, embedder=emb)
    assert rep.first().asDict() == {"succeeded": 6, "total": 8}
    r, v, rep, _ = jobs.embed_pending(recs, vecs, embedder=emb, mode=FAIL_STOP)
    assert rep.first().asDict() == {"succeeded": 3, "total": 8}
    assert sorted(x.id for x in r.where("embedding IS NOT NULL").collect()) == [1, 2, 3]
    assert sorted(x.id for x in v.collect()) == [1, 2, 3]


def test_search_drops_blank_queries_and_joins_after_top_k(spark):
    recs = records_df(spark, [(1, "aaa", "", "x", "", None), (2, "bbb", "", "y", "", None)])
    vecs = spark.createDataFrame([], "id long, v array<double>")
    r, v, _, _ = jobs.embed_pending(recs, vecs)
    # An orphan vector (no record) still takes a place in the top-k.
    from tidepool.operators.embed import LETTERS
    orphan = spark.createDataFrame([(99, [1.0, 1.0] + [0.0] * (LETTERS - 2))], "id long, v array<double>")
    q = spark.createDataFrame([(1, "  ab  "), (2, "   ")], "qid long, text string")
    got = jobs.search(r, v.unionByName(orphan), q, k=1).collect()
    assert [(x.qid, x.rank) for x in got] == []  # the best match is the orphan
    got = jobs.search(r, v.unionByName(orphan), q, k=2).collect()
    assert [(x.qid, x.rank, x.id) for x in got] == [(1, 2, 1)]


def test_fail_stop_calls_no_wave_after_the_first_failure(spark, monkeypatch):
    import pyarrow as pa

    from tidepool.operators import embed as E

    monkeypatch.setattr(E, "FIRST_WAVE", 8)
    seen = spark.sparkContext.accumulator(0)

    def counting(bad_id):
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            seen.add(batch.num_rows)
            out = E.letter_histogram(batch)
            bad = pa.array([i == bad_id for i in batch.column(0).to_pylist()])
            err = pa.compute.if_else(bad, pa.scalar("down"), out.column(2))
            v = pa.compute.if_else(bad, pa.nulls(batch.num_rows, out.column(1).type), out.column(1))
            return pa.RecordBatch.from_arrays([out.column(0), v, err], names=["id", "v", "error"])
        return run

    recs = records_df(spark, [(i, f"q{i}", "", "a", "", None) for i in range(1, 301)])
    vecs = spark.createDataFrame([], "id long, v array<double>")
    for bad, called in ((3, 8), (20, 40), (150, 200), (0, 300)):  # waves end at 8, 40, 200 and 300 rows
        before = seen.value
        r, v, rep, emb = jobs.embed_pending(recs, vecs, embedder=counting(bad), mode=E.FAIL_STOP)
        good = bad - 1 if bad else 300
        assert rep.first().asDict() == {"succeeded": good, "total": 300}
        assert sorted(x.id for x in v.collect()) == list(range(1, good + 1))
        assert {x.error for x in emb.where(F.col("id") > bad).collect()} == ({"stopped"} if bad else {None})
        assert seen.value - before == called


@pytest.mark.parametrize("depth", [20_000, 200_000])
def test_deeply_nested_lines_are_malformed(spark, depth):
    deep = "[" * depth + "]" * depth
    objects = '{"a":' * (depth // 4) + "1" + "}" * (depth // 4)
    lines = ['{"instruction":"a","output":"b","x":' + deep + "}", deep, '{"instruction":"a","output":"' + deep + '"}',
             '{"instruction":"a","output":"b","x":' + objects + "}", '{"instruction":"a","output":"b","x":"\\"' + "[" * 5000 + '"}',
             '{"instruction":"a","output":"b","x":[' + "[]," * 5000 + "1]}"]
    got = {r.line_no: r.status for r in jobs.line_status(lines_df(spark, lines), ["line_no"]).collect()}
    assert [got[i] for i in range(6)] == ["malformed", "malformed", "valid", "malformed", "valid", "valid"]


def test_long_and_partial_lines(spark):
    from tidepool.plans import jobs

    digits, deep = "7" * 1500, "[" * 1100 + "]" * 1100
    lines = ['{"instruction":"INFO log","output":"' + "a" * 200_000 + '"}', '{"instruction":"a","output":"b","source":"\\u00"}',
             '{"instruction":"a","output":"c","n":' + digits + "}", '{"instruction":"a","output":"d","n":' + deep + "}"]
    got = {r.line_no: r.status for r in jobs.line_status(lines_df(spark, lines), ["line_no"]).collect()}
    assert got[0] == got[2] == got[3] == "valid" and got[1] == "malformed"
