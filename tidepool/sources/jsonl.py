"""JSONL source and sink.

S1  line scan with an order key that survives file splits,
S2/P1-P5  strict per-line classification with native JSON parsing,
K1  ordered export.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidepool.functions.text import is_blank, record_json, ustrip
from tidepool.schema import (
    BAD_TYPE,
    BAD_UTF8,
    BLANK_REQUIRED,
    FIELDS,
    MALFORMED,
    NOT_OBJECT,
    VALID,
)
from tidepool.session import hadoop_path

# Order key of a scanned line: file, split start, row number inside the task.
ORDER_COLS = ("src_file", "src_block", "src_row")

_NO_CAP = str(2**31 - 1)
#: A line whose arrays and objects are nested deeper is malformed: the parser takes a stack frame a level.
MAX_DEPTH = 2000
#: Strict JSON, without the parser's own limits on strings, numbers and nesting.
_STRICT = {"allowSingleQuotes": "false", "maxStringLen": _NO_CAP, "maxNumLen": _NO_CAP, "maxNestingDepth": _NO_CAP}
_VARIANT_FIELDS = ",".join(f"{f}:variant" for f in FIELDS)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every physical line of the JSONL files, with an exact order key.

    ``(src_file, src_block, src_row)`` sorts lines in file order across files and
    splits: a split is read sequentially by one task, so the task-local row id
    grows with the line position inside it.
    """
    paths = [path] if isinstance(path, str) else list(path)
    raw = spark.read.text(paths)
    return raw.select(
        F.col("_metadata.file_path").alias("src_file"),
        F.col("_metadata.file_block_start").alias("src_block"),
        F.monotonically_increasing_id().alias("src_row"),
        F.col("value").alias("line"),
    )


def read_changes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A change file: id, op, the four fields, and line_order, which sorts the changes as their lines."""
    schema = "id long, op string, instruction string, input string, output string, source string"
    lines = non_blank(read_lines(spark, path))
    change = F.from_json("line", schema, {**_STRICT, "mode": "FAILFAST"}).alias("c")
    return lines.select(F.struct(*ORDER_COLS).alias("line_order"), change).select("c.*", "line_order")


def non_blank(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Drop lines that are empty after the Unicode strip; keep the stripped text."""
    stripped = ustrip(line_col)
    return lines.withColumn(line_col, stripped).where(F.col(line_col) != F.lit(""))


def _without_strings(s: Column) -> Column:
    return F.regexp_replace(s, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', '""')  # possessive: no stack per character


def _bad_non_numeric(s: Column) -> Column:
    """Non-finite literals that the JVM parser accepts but a strict decoder refuses.

    NaN, Infinity and -Infinity are accepted by both; +INF, +Infinity and -INF only
    by the JVM parser. String contents are blanked first so text is not matched.
    """
    outside = _without_strings(s)
    hit = outside.rlike(r"(?:^|[^A-Za-z0-9_])(?:\+INF|\+Infinity|-INF(?!inity))")
    guard = s.contains("INF") | s.contains("+Infinity")
    return F.when(guard, hit).otherwise(F.lit(False))


def too_deep(s: Column, limit: int = MAX_DEPTH) -> Column:
    """Whether brackets outside strings are nested deeper than ``limit``, found without a parser.

    Only a line with more opening brackets than that, strings included, is looked at closer.
    """
    brackets = F.regexp_replace(_without_strings(s), r"[^\[\]{}]++", "")
    steps = F.transform(F.split(brackets, ""), lambda c: F.when(c.isin("[", "{"), F.lit(1)).when(c.isin("]", "}"), F.lit(-1)).otherwise(F.lit(0)))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    walked = F.aggregate(steps, start, lambda a, x: F.struct((a["now"] + x).alias("now"), F.greatest(a["most"], a["now"] + x).alias("most")))
    openers = F.length(s) - F.length(F.translate(s, "[{", ""))
    return F.when(openers > F.lit(limit), walked.getField("most") > F.lit(limit)).otherwise(F.lit(False))


def classify(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Add ``status`` and the four string fields of a non-blank line.

    Status, tested in this order: bad_utf8 (the raw bytes are not UTF-8; the
    text reader does not validate), malformed (not one JSON value, or nested deeper
    than ``MAX_DEPTH``), not_object,
    bad_type (a present field that is not a string, including null),
    blank_required (instruction or output blank after the strip), valid.
    Fields default to '' when missing and are NULL when the line is not valid.
    """
    spark = lines.sparkSession
    # A duplicate key nested in an ignored value must not make the line malformed.
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    lines = lines.withColumn("_shallow", F.when(~too_deep(F.col(line_col)), F.col(line_col)))
    s = F.col("_shallow")
    wrapped_obj = F.concat(F.lit('{"r":'), s, F.lit("}"))
    wrapped_arr = F.concat(F.lit("["), s, F.lit("]"))
    a = F.from_json(wrapped_obj, f"struct<r:struct<{_VARIANT_FIELDS}>>", _STRICT)
    b = F.from_json(wrapped_arr, f"array<struct<{_VARIANT_FIELDS}>>", _STRICT)
    av = F.from_json(wrapped_obj, "struct<r:variant>", _STRICT)
    bv = F.from_json(wrapped_arr, "array<variant>", _STRICT)

    parsed = lines.withColumn("_a", a.getField("r")).withColumn("_b", b)
    bad_nn = _bad_non_numeric(s)
    is_json = (av.getField("r").isNotNull() & (F.size(bv) == F.lit(1))) & ~bad_nn
    # A partly parsed object has fields that look missing: the whole value must be JSON too.
    is_object = (
        F.col("_a").isNotNull()
        & (F.size("_b") == F.lit(1))
        & F.get(F.col("_b"), 0).isNotNull()
        & is_json
    )

    def field(f: str) -> Column:
        return F.col("_a").getField(f)

    type_ok = None
    for f in FIELDS:
        ok = field(f).isNull() | (F.schema_of_variant(field(f)) == F.lit("STRING"))
        type_ok = ok if type_ok is None else (type_ok & ok)

    values = {
        f: F.coalesce(F.variant_get(field(f), "$", "string"), F.lit("")) for f in FIELDS
    }
    status = (
        F.when(~F.is_valid_utf8(F.col(line_col)), F.lit(BAD_UTF8))
        .when(is_object & type_ok & ~is_blank(values["instruction"]) & ~is_blank(values["output"]), F.lit(VALID))
        .when(is_object & type_ok, F.lit(BLANK_REQUIRED))
        .when(is_object, F.lit(BAD_TYPE))
        .when(is_json, F.lit(NOT_OBJECT))
        .otherwise(F.lit(MALFORMED))
    )
    # A generated column: a filter on the status stays above the parse instead of repeating it for each use below.
    out = parsed.withColumn("_status", status).withColumn("status", F.explode(F.array("_status"))).drop("_status")
    for f in FIELDS:
        out = out.withColumn(f, F.when(F.col("status") == F.lit(VALID), values[f]))
    return out.drop("_a", "_b", "_shallow")


def write_jsonl(records: DataFrame, path: str, one_file: bool = False) -> int:
    """K1: write every record as one JSON line, in id order; returns the row count.

    The sort is a range-partitioned global sort, so part files in name order are
    in id order. ``one_file``: the parts are joined in that order into one file at ``path``.
    Everything is written beside the target, which is swapped at the end, so a failed job
    leaves an older export as it was. Nothing is written for an empty store (returns 0).
    """
    spark = records.sparkSession
    written = Observation()
    out = records.orderBy("id").select(record_json().alias("value"))
    aside = f"{path.rstrip('/')}.writing-{uuid.uuid4().hex[:12]}"
    fs, target = hadoop_path(spark, path.rstrip("/"))
    _, parts = hadoop_path(spark, aside)
    try:
        # Observed above the sort, so that its range sample is not counted.
        out.observe(written, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").text(aside)
        n = int(written.get["n"])
        if n and one_file:
            _, joined = hadoop_path(spark, f"{aside}.joined")
            _join_parts(spark, fs, parts, joined)
            _swap(spark, fs, joined, target)
        elif n:
            _swap(spark, fs, parts, target)
        return n
    finally:
        fs.delete(parts, True)


def _join_parts(spark: SparkSession, fs, parts, joined) -> None:
    """The part files of a folder, in name order, as one file: bytes stream from file to file."""
    jvm = spark.sparkContext._jvm
    names = sorted(st.getPath().getName() for st in fs.listStatus(parts) if st.getPath().getName().startswith("part-"))
    out = fs.create(joined, False)
    try:
        for name in names:
            part = fs.open(jvm.org.apache.hadoop.fs.Path(parts, name))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            finally:
                part.close()
    finally:
        out.close()


def _swap(spark: SparkSession, fs, new, target) -> None:
    """Put ``new`` in the place of ``target``; the older one goes last."""
    jvm = spark.sparkContext._jvm
    older = jvm.org.apache.hadoop.fs.Path(f"{target.toString()}.older-{uuid.uuid4().hex[:12]}")
    had = fs.exists(target)
    if had and not fs.rename(target, older):
        raise OSError(f"cannot move {target.toString()} aside")
    if not fs.rename(new, target):
        if had:
            fs.rename(older, target)
        raise OSError(f"cannot move the export to {target.toString()}")
    if had:
        fs.delete(older, True)
