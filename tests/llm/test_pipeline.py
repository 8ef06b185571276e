"""The pipeline's stages on awkward rows; test_pipeline_near.py has the whole run against plain Python."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tests.llm import cases

pytestmark = pytest.mark.skipif(not cases.HAVE, reason="driver tables not present")


def test_stages_take_awkward_rows(spark):
    docs = cases.documents(spark, [*cases.ODD, *cases.ODD[7:9], (None, cases.PASSAGE), (None, None)])
    empty = docs.limit(0)
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, cases.SF)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count() and step(spark, empty, cases.SF).count() == 0
