"""Scalar text functions against Python's own string semantics."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidepool.functions import text as T
from tidepool.schema import WS

EDGE = ["", " ", "a", " a ", "　x　", "\x1c\x1dy\x1e\x1f", "\x85z\xa0", "  ",
        "a\nb", "a\r\nb", "a\rb", "a\n", "a\n\n", "\n", "a\x0bb\x0cc", "x" * 45, "é" * 41,
        "line1\nline2\n" + "w" * 50, " a ", "tab\tkeep", "a\x1cb"]


def py_preview(text, limit=40):
    flat = " ".join(text.splitlines())
    return flat[:limit] + "…" if len(flat) > limit else flat


def test_ws_is_python_isspace():
    assert len(WS) == 29
    assert all(c.isspace() for c in WS)


def _eval(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r.o for r in df.select("i", fn(F.col("s")).alias("o")).orderBy("i").collect()]


def test_strip_and_preview_edges(spark):
    assert _eval(spark, EDGE, T.ustrip) == [s.strip() for s in EDGE]
    assert _eval(spark, EDGE, T.preview) == [py_preview(s) for s in EDGE]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab \n\r\t　 \x85\x1c\x0b")), max_size=60),
                min_size=1, max_size=20))
def test_strip_and_preview_property(spark, values):
    assert _eval(spark, values, T.ustrip) == [s.strip() for s in values]
    assert _eval(spark, values, T.preview) == [py_preview(s) for s in values]


def test_embedding_text(spark):
    rows = [("Sort these", "b, a"), ("Sort these", None), ("\tSort ñ\n", "\u2003"), ("\u3000Sort\u00a0", " b,\na ")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r.t for r in df.select(T.embedding_text("a", "b").alias("t")).collect()]
    assert got == ["Sort these\n\nb, a", "Sort these", "Sort ñ", "Sort\n\nb,\na"]


def test_trim_trailing_newlines_and_score_format(spark):
    assert _eval(spark, ["a\n\n", "a\n b\n", "\n"], T.trim_trailing_newlines) == ["a", "a\n b", ""]
    df = spark.createDataFrame([(0.0625,), (0.9305,), (1.0,), (None,)], "x double")
    got = [r.s for r in df.select(T.score_format("x").alias("s")).collect()]
    assert got == [f"{0.0625:.3f}", f"{0.9305:.3f}", "1.000", None]


def test_score_format_rounds_as_python_does(spark):
    import math
    import random

    rng = random.Random(4)
    values = [x / 16000 for x in range(-16000, 16001, 7)] + [rng.uniform(-1, 1) for _ in range(3000)] + [k / 2000 for k in range(-2000, 2001)]
    values += [math.nextafter(k / 2000, s) for k in range(-2000, 2001, 3) for s in (-9, 9)] + [-0.0, -0.0001, 1e-300, 5e-324, math.inf, -math.inf, 1234567.8905]
    df = spark.createDataFrame([(float(x),) for x in values] + [(math.nan,)], "x double")
    got = [r.s for r in df.select(T.score_format("x").alias("s")).collect()]
    assert got == [f"{x:.3f}" for x in values] + [None]


def test_record_json_is_ordered_and_unescaped(spark):
    import json

    df = spark.createDataFrame([("naïve café?", "", "say \"hi\"\nthen go", "menu")], "instruction string, input string, output string, source string")
    line = df.select(T.record_json().alias("j")).first().j
    assert list(json.loads(line)) == ["instruction", "input", "output", "source"]
    assert "naïve café?" in line
    assert json.loads(line)["output"] == "say \"hi\"\nthen go"
