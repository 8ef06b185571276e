"""Bulk store changes (W1-W3, W5-W7) as joins over change sets.

Each operator maps ``(records, vectors, change set)`` to new tables; nothing is
changed in place. Change sets are DataFrames keyed by id, joined with a shuffle
on id (or a broadcast when Spark measures them small).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions.text import is_blank, trim_trailing_newlines
from tidepool.functions.vector import nonzero
from tidepool.schema import FIELDS, RECORD_SCHEMA

OPS = ("insert", "update", "delete")


def ts_literal(as_of: dt.datetime) -> F.Column:
    """A wall-clock TIMESTAMP_NTZ literal, independent of any time zone setting."""
    return F.lit(as_of.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")


def stamp_new(new: DataFrame, as_of: dt.datetime) -> DataFrame:
    """New rows (id, four fields, optional embedding) as records stamped ``as_of``."""
    ts = ts_literal(as_of)
    emb = F.col("embedding") if "embedding" in new.columns else F.lit(None)
    return new.select(
        F.col("id").cast("long"), *FIELDS,
        ts.alias("created_at"), ts.alias("updated_at"),
        emb.cast("array<double>").alias("embedding"),
    )


def _last_per_id(changes: DataFrame, order_col: str | None) -> DataFrame:
    """The last change per id by ``order_col``, as an aggregate with a map-side
    partial (an id edited a million times costs one row per task). Changes that
    are equal in the order resolve to the greatest. Without an order, several
    different changes of one id raise: none of them is the last."""
    cols = [c for c in changes.columns if c not in ("id",)]
    if order_col is None:
        least, pick = F.min(F.struct(*cols)), F.max(F.struct(*cols))
        pick = F.when(least.eqNullSafe(pick), pick).otherwise(
            F.raise_error(F.lit("several changes of one id need an order column")))
    else:
        pick = F.max_by(F.struct(*cols), F.struct(F.col(order_col), *cols))
    last = changes.groupBy("id").agg(pick.alias("_last"))
    return last.select("id", *[F.col("_last").getField(c).alias(c) for c in cols])


def update(records: DataFrame, vectors: DataFrame, changes: DataFrame, as_of: dt.datetime,
           order_col: str | None = None, trim_newlines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Replace the four text fields of matching ids, clear the embedding,
    set updated_at, keep created_at, drop the vector row. A change with a blank
    instruction or output is refused; an unknown id is a no-op. With several
    changes per id the last by ``order_col`` wins. ``trim_newlines`` applies F4
    (trailing line feeds removed, as for hand-typed entries) before the check."""
    if trim_newlines:
        changes = changes.select(
            *[trim_trailing_newlines(c).alias(c) if c in FIELDS else F.col(c) for c in changes.columns]
        )
    ok = changes.where(~is_blank("instruction") & ~is_blank("output"))
    ch = _last_per_id(ok, order_col).select(
        F.col("id").cast("long"), *[F.col(f).alias(f"_n_{f}") for f in FIELDS]
    ).withColumn("_hit", F.lit(True))
    joined = records.join(ch, "id", "left")
    hit = F.col("_hit").isNotNull()
    out = joined.select(
        "id",
        *[F.when(hit, F.coalesce(F.col(f"_n_{f}"), F.lit(""))).otherwise(F.col(f)).alias(f) for f in FIELDS],
        "created_at",
        F.when(hit, ts_literal(as_of)).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(hit, F.lit(None).cast("array<double>")).otherwise(F.col("embedding")).alias("embedding"),
    )
    applied = records.select("id").join(ch.select("id"), "id", "left_semi")
    return out, clear_vectors(vectors, applied)


def delete(records: DataFrame, vectors: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove ids from both tables; unknown ids are a no-op."""
    gone = ids.select(F.col("id").cast("long")).distinct()
    return records.join(gone, "id", "left_anti"), vectors.join(gone, "id", "left_anti")


def clear_vectors(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """Drop vector rows; the record column is not touched."""
    return vectors.join(ids.select(F.col("id").cast("long")).distinct(), "id", "left_anti")


def _last_vectors(new: DataFrame, order_col: str | None) -> DataFrame:
    """(id, v): the last vector of each id."""
    order = [F.col(order_col)] if order_col else []
    picked = new.select(F.col("id").cast("long"), F.col("v").cast("array<double>"), *order)
    return _last_per_id(picked, order_col).select("id", "v")


def upsert_vectors(vectors: DataFrame, new: DataFrame, order_col: str | None = None) -> DataFrame:
    """Delete then insert, unless the new vector is all zeros (which thus
    removes an older row). Of several vectors of an id the last by ``order_col`` counts."""
    fresh = _last_vectors(new, order_col)
    kept = vectors.select("id", "v").join(fresh.select("id"), "id", "left_anti")
    return kept.unionByName(fresh.where(nonzero("v")))


def save_embeddings(records: DataFrame, vectors: DataFrame, new: DataFrame,
                    order_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Store each new vector on its record (replacing any earlier one) and in
    the vector table (W6). Ids without a record are ignored. Of several vectors
    of an id the last by ``order_col`` counts."""
    fresh = (
        _last_vectors(new, order_col).withColumnRenamed("v", "_nv")
        .join(records.select("id"), "id", "left_semi")
    )
    out = records.join(fresh, "id", "left").select(
        *[c for c in RECORD_SCHEMA.fieldNames() if c != "embedding"],
        F.coalesce(F.col("_nv"), F.col("embedding")).alias("embedding"),
    )
    return out, upsert_vectors(vectors, fresh.select("id", F.col("_nv").alias("v")))


def apply_changes(records: DataFrame, vectors: DataFrame, changes: DataFrame, as_of: dt.datetime,
                  order_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """J-CHANGE: ``changes(id, op, instruction, input, output, source)`` with op
    'update' or 'delete'; updates first, then deletes. A delete wins whatever the
    order: an update after it finds no record, and ids are not used again."""
    ups = changes.where(F.col("op") == F.lit("update"))
    dels = changes.where(F.col("op") == F.lit("delete")).select("id")
    r1, v1 = update(records, vectors, ups, as_of, order_col)
    return delete(r1, v1, dels)
