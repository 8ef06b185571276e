"""The fixture sizes and import counts measured independently (FIXTURES.md B)."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tidepool import catalog as C
from tidepool.functions.vector import nonzero
from tidepool.plans import fixtures as fx

EXPECTED = {
    # store rows, distinct triples, lines, blank lines, added, duplicate, invalid,
    # near/far/zero copies, near-duplicates, records with vector / zero vector,
    # pending, index rows, deletes / updates (two of each id), rows / edited after the changes.
    # The figures of the records come from the oracle's SQL.
    "sf0.001": dict(store=18, triples=18, lines=180, blank=5, added=112, duplicate=6, invalid=57,
                    kinds=(100, 100, 10), near=100, with_vec=166, zero=2, pending=8, index=86,
                    changes=(6, 9), after=(169, 3)),
    "sf0.01": dict(store=94, triples=94, lines=900, blank=25, added=607, duplicate=41, invalid=227,
                   kinds=(100, 100, 10), near=100, with_vec=447, zero=4, pending=484, index=236,
                   changes=(34, 41), after=(898, 13)),
}


@pytest.mark.parametrize("sf", sorted(EXPECTED))
def test_fixture_sizes(spark, sf):
    d = f"/root/testdata/{sf}"
    if not os.path.isdir(d):
        pytest.skip("driver tables not present")
    e = EXPECTED[sf]
    store = fx.fx_store(spark, d)
    assert store.count() == e["store"]
    assert store.select("instruction", "input", "output").distinct().count() == e["triples"]
    lines = fx.fx_lines(spark, d)
    assert lines.count() == e["lines"]
    assert lines.where(F.btrim("line", F.lit(" ")) == "").count() == e["blank"]
    rep = C.QUERIES["import_report"](spark, d).first()
    assert (rep.added, rep.duplicate, rep.invalid) == (e["added"], e["duplicate"], e["invalid"])
    kinds = {r.kind: r.n for r in fx.fx_vec(spark, d).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert (kinds["near"], kinds["far"], kinds["zero"]) == e["kinds"]
    assert C.QUERIES["near_duplicates"](spark, d).count() == e["near"]
    recs = fx.fx_records(spark, d)
    assert recs.where(F.col("embedding").isNotNull()).count() == e["with_vec"]
    assert recs.where(F.col("embedding").isNotNull() & ~nonzero("embedding")).count() == e["zero"]
    assert recs.where(F.col("embedding").isNull()).count() == e["pending"]
    assert fx.fx_index(spark, d).count() == e["index"]
    ch = fx.fx_changes(spark, d)  # counts include the two unknown ids
    assert (ch.where("op = 'delete'").count(), ch.where("op = 'update'").count()) == e["changes"]
    after = C.QUERIES["apply_changes"](spark, d)
    edited = after.where(F.col("instruction").endswith(" (edited)")).count()
    assert (after.count(), edited) == e["after"]
