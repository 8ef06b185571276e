"""Schemas, key columns and fixed values of the record store."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values that must equal the original tool's behaviour.
NEAR_DUPLICATE_THRESHOLD = 0.93  # cosine similarity, inclusive
SEARCH_K = 20  # rows shown by an interactive similarity search
DEFAULT_DIM = 768  # embedding dimension of the default model
PREVIEW_LIMIT = 40  # code points kept by the listing preview
ELLIPSIS = "…"

# Status values of one input line, in the order they are tested.
BAD_UTF8 = "bad_utf8"
MALFORMED = "malformed"
NOT_OBJECT = "not_object"
BAD_TYPE = "bad_type"
BLANK_REQUIRED = "blank_required"
VALID = "valid"
DUPLICATE = "duplicate"
ADDED = "added"
INVALID_STATUSES = (BAD_UTF8, MALFORMED, NOT_OBJECT, BAD_TYPE, BLANK_REQUIRED)

# The fields read from a JSONL object, and the exact-duplicate key.
FIELDS = ("instruction", "input", "output", "source")
KEY = ("instruction", "input", "output")

# Whitespace removed by the strip used for blank checks: every code point that
# Python's str.isspace() accepts (29 of them), derived from that rule.
WS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("instruction", T.StringType(), False),
        T.StructField("input", T.StringType(), False),
        T.StructField("output", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("created_at", T.TimestampNTZType(), False),
        T.StructField("updated_at", T.TimestampNTZType(), False),
        T.StructField("embedding", T.ArrayType(T.DoubleType(), True), True),
    ]
)

VECTOR_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("v", T.ArrayType(T.DoubleType(), True), False),
    ]
)

# Additive migration targets: column -> SQL default for rows written before it.
MIGRATION_DEFAULTS = {"source": "''", "embedding": "CAST(NULL AS ARRAY<DOUBLE>)"}
