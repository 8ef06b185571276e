"""Scalar text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepool.schema import ELLIPSIS, FIELDS, PREVIEW_LIMIT, WS

# Line breaks recognised by Python's str.splitlines (CRLF counts as one).
LINE_BREAK = r"(?:\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}])"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ustrip(c: Column | str) -> Column:
    """Strip Unicode whitespace (the str.isspace set) from both ends."""
    return F.btrim(_c(c), F.lit(WS))


def is_blank(c: Column | str) -> Column:
    """Only whitespace (or empty): the left trim consumes everything."""
    return F.ltrim(_c(c), F.lit(WS)) == F.lit("")


def embedding_text(instruction: Column | str, input_value: Column | str) -> Column:
    """strip(instruction), plus a blank line and strip(input) when input is not blank."""
    ins = ustrip(instruction)
    inp = ustrip(input_value)
    return F.when(inp != F.lit(""), F.concat(ins, F.lit("\n\n"), inp)).otherwise(ins)


def preview(c: Column | str, limit: int = PREVIEW_LIMIT) -> Column:
    """Join the lines of a text with spaces and cut it to ``limit`` code points."""
    no_last = F.regexp_replace(_c(c), LINE_BREAK + r"\z", "")
    flat = F.regexp_replace(no_last, LINE_BREAK, " ")
    return F.when(
        F.char_length(flat) > F.lit(limit),
        F.concat(F.substring(flat, 1, limit), F.lit(ELLIPSIS)),
    ).otherwise(flat)


def trim_trailing_newlines(c: Column | str) -> Column:
    """Remove every trailing LF (manual entry only)."""
    return F.rtrim(_c(c), F.lit("\n"))


def record_json(prefix: str = "") -> Column:
    """One export line: the four text fields in fixed order, non-ASCII unescaped."""
    return F.to_json(F.struct(*[F.col(prefix + f).alias(f) for f in FIELDS]))


def score_format(c: Column | str) -> Column:
    """Three-decimal score text as the listing shows it: half-even on the exact binary value; NULL for NaN."""
    x = _c(c)
    # The JVM takes 0.0005 for a tie between 0.000 and 0.001; the double is above it.
    least = F.when(x > 0, F.lit("0.001")).otherwise(F.lit("-0.001"))
    infinite = F.when(x > 0, F.lit("inf")).otherwise(F.lit("-inf"))
    return F.when(x.isNull() | F.isnan(x), F.lit(None)).when(F.abs(x) == F.lit(float("inf")), infinite).when(F.abs(x) == F.lit(0.0005), least).otherwise(F.call_function("format_number", x, F.lit("0.000")))
