"""Rows that share a doc_id, or have none, have verdicts of their own in the pipeline."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tests.llm import cases

pytestmark = pytest.mark.skipif(not cases.HAVE, reason="driver tables not present")


def left(spark, stage, rows):
    out = dict(corpus_pipeline.STAGES)[stage](spark, cases.documents(spark, rows), cases.SF)
    return cases.rows(out, "doc_id", "text")


def test_each_row_has_its_own_verdict(spark):
    good, other, third = (" ".join(f"{c}{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(80)) for c in ("x", "y", "z"))
    kept, poor = [(None, good), (5, other), (5, third)], [(None, "too short"), (5, "too short"), (5, "so short")]
    assert left(spark, "quality_rules", kept + poor) == cases.ordered(kept)
    item = spark.read.parquet(f"{cases.SF}/benchmark.parquet").where("length(text) > 100").first().text
    assert left(spark, "decontamination", [*kept, (None, item), (5, f"word {item}")]) == cases.ordered(kept)
    copy = " ".join(w if i != 40 else "changed" for i, w in enumerate(third.split()))
    kept = [(None, good), (5, other), (3, third)]
    assert left(spark, "near_duplicates", [*kept, (5, copy), (None, copy + " more")]) == cases.ordered(kept)


def test_copies_without_ids_of_their_own_leave_one(spark):
    a, b = (" ".join(f"{c}{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(80)) for c in ("x", "y"))
    near = lambda t: " ".join(w if i != 40 else "changed" for i, w in enumerate(t.split()))
    rows = [(None, a), (None, near(a)), (None, a), (5, b), (5, near(b)), (5, b), (None, ""), (None, ""), (5, None), (7, near(a) + " end")]
    out = left(spark, "near_duplicates", rows)
    assert [r for r in out if r[1] in ("", None)] == cases.ordered([(None, ""), (None, ""), (5, None)])
    assert [r for r in out if r[1] and r[1][0] == "x"] == [(7, near(a) + " end")]  # an id goes before none
    assert len([r for r in out if r[1] and r[1][0] == "y"]) == 1
