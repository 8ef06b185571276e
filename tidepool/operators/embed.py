"""X1 pluggable embedder, F11 dimension check and D3 failure handling.

An embedder is a batch function ``pyarrow.RecordBatch(id, text) ->
pyarrow.RecordBatch(id, v, error)`` run through ``mapInArrow``: one call per
Arrow batch, never per row. A real model client plugs in the same way.

The bundled test embedder is a letter histogram (counts of a..z, ASCII letters
only, case-insensitive): deterministic, model-free and checkable in SQL. A text
without letters yields the zero vector.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions.vector import finite
from tidepool.session import ship_package, stage

Embedder = Callable[[pa.RecordBatch], pa.RecordBatch]
EMBED_SCHEMA = "id long, v array<double>, error string"
LETTERS = 26

PER_ROW = "per_row"
FAIL_STOP = "fail_stop"
BAD_DIMENSION = "bad_dimension"


def _string_bytes(arr: pa.Array):
    """(offsets, data) of a string array as NumPy views, nulls as empty."""
    arr = arr.cast(pa.large_string()) if arr.type != pa.large_string() else arr
    arr = pc.fill_null(arr, "")
    bufs = arr.buffers()
    offsets = np.frombuffer(bufs[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return offsets, data


def letter_counts(texts: pa.Array) -> np.ndarray:
    """(n, 26) float matrix of ASCII letter counts, vectorised over the batch."""
    n = len(texts)
    if n == 0:
        return np.zeros((0, LETTERS))
    offsets, data = _string_bytes(texts)
    lo, hi = int(offsets[0]), int(offsets[-1])
    chunk = data[lo:hi]
    seg = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    lower = chunk | 0x20  # folds A-Z onto a-z; UTF-8 lead and tail bytes stay >= 0x80
    is_letter = (lower >= 97) & (lower <= 122)
    codes = seg[is_letter] * LETTERS + (lower[is_letter].astype(np.int64) - 97)
    return np.bincount(codes, minlength=n * LETTERS).reshape(n, LETTERS).astype(np.float64)


def letter_histogram(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The test embedder: never fails."""
    counts = letter_counts(batch.column(1))
    v = pa.FixedSizeListArray.from_arrays(pa.array(counts.ravel(), pa.float64()), LETTERS)
    return pa.RecordBatch.from_arrays(
        [batch.column(0), v.cast(pa.list_(pa.float64())), pa.nulls(batch.num_rows, pa.string())],
        names=["id", "v", "error"],
    )


def flaky(embedder: Embedder, every: int, message: str = "embedder unavailable") -> Embedder:
    """Fault injection for tests: fail the rows whose id is a multiple of ``every``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = embedder(batch)
        ids = out.column(0).to_numpy()
        bad = (ids % every) == 0
        v = pc.if_else(pa.array(bad), pa.nulls(len(ids), out.column(1).type), out.column(1))
        err = pc.if_else(pa.array(bad), pa.scalar(message), out.column(2))
        return pa.RecordBatch.from_arrays([out.column(0), v, err], names=["id", "v", "error"])

    return run


def _failed(batch: pa.RecordBatch, message: str) -> pa.RecordBatch:
    n = batch.num_rows
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.nulls(n, pa.list_(pa.float64())), pa.array([message] * n, pa.string())],
        names=["id", "v", "error"],
    )


def embed(df: DataFrame, text_col: str = "text", id_col: str = "id",
          embedder: Embedder = letter_histogram, dim: int | None = LETTERS,
          breaker: int | None = None, batch_rows: int | None = None) -> DataFrame:
    """Run the embedder over ``(id, text)``; returns ``(id, v, error)``.

    F11: a vector that is empty, not of ``dim`` components or not finite is a failed row.
    ``breaker``: after that many consecutive failed batches in one task the
    embedder is not called again in that task; its remaining rows fail with
    "embedder unavailable" (a dead model service is not called row after row).
    ``batch_rows``: the embedder sees batches of at most that many rows (a
    model's request size), cut from Spark's Arrow batches without copying.
    """
    ship_package(df.sparkSession)

    def pieces(batches):
        for b in batches:
            if batch_rows is None or b.num_rows <= batch_rows:
                yield b
            else:
                for off in range(0, b.num_rows, batch_rows):
                    yield b.slice(off, batch_rows)

    def run(batches):
        misses = 0
        for b in pieces(batches):
            if not b.num_rows:
                continue
            if breaker is not None and misses >= breaker:
                yield _failed(b, "embedder unavailable")
                continue
            try:
                out = embedder(b)
            except Exception as exc:  # noqa: BLE001 - a model error fails the batch's rows
                out = _failed(b, f"embedder error: {type(exc).__name__}")
            all_failed = out.column(2).null_count == 0
            misses = misses + 1 if all_failed else 0
            yield out

    out = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, EMBED_SCHEMA
    )
    if dim is None:
        ok = F.col("v").isNotNull() & (F.size("v") > F.lit(0))
    else:
        ok = F.col("v").isNotNull() & (F.size("v") == F.lit(dim))
    sound = ok & finite("v")
    return out.select(
        "id",
        F.when(F.col("error").isNull() & sound, F.col("v")).alias("v"),
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(~ok, F.lit(BAD_DIMENSION))
        .when(~sound, F.lit("non_finite"))
        .alias("error"),
    )


FIRST_WAVE = 256  # rows; each wave after it is WAVE_GROWTH times as long
WAVE_GROWTH = 4


def embed_in_waves(df: DataFrame, id_col: str = "id", **how) -> DataFrame:
    """D3: ``embed`` in waves of growing size, in id order, that end at the first failure.

    Of the wave that holds the first failed id, rows at or after it get no vector; later waves
    are not embedded at all (error ``stopped``). The number of waves grows with the logarithm
    of the rows, so large inputs run in parallel. Every wave is staged: one model call a row.
    """
    n = df.count()
    ends, size = [], FIRST_WAVE
    while size < n:
        ends.append(size / n)
        size *= 1 + WAVE_GROWTH
    cuts = sorted(set(df.agg(F.percentile_approx(id_col, ends, 100_000)).first()[0])) if ends else []
    done = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        wave = df if low is None else df.where(F.col(id_col) > F.lit(low))
        wave = wave if high is None else wave.where(F.col(id_col) <= F.lit(high))
        out = stage(embed(wave, id_col=id_col, **how), "embedded")
        first = out.where(F.col("error").isNotNull()).agg(F.min("id")).first()[0]
        if first is not None:
            out = _stopped(out, int(first))
        done = out if done is None else done.unionByName(out)
        if first is not None:
            if high is not None:
                rest = df.where(F.col(id_col) > F.lit(high)).select(F.col(id_col).cast("long").alias("id"))
                done = done.unionByName(rest.select("id", F.lit(None).cast("array<double>").alias("v"), F.lit("stopped").alias("error")))
            break
    return done


def embed_by_mode(df: DataFrame, mode: str = PER_ROW, **how) -> DataFrame:
    """Embedded rows, staged. ``per_row``: a failed row stays pending, the others keep their
    vector. ``fail_stop``: rows at or after the first failure (in id order) get none (D3)."""
    if mode == PER_ROW:
        return stage(embed(df, **how), "embedded")
    if mode != FAIL_STOP:
        raise ValueError(f"unknown failure mode {mode!r}")
    return embed_in_waves(df, **how)


def _stopped(embedded: DataFrame, first: int) -> DataFrame:
    before = F.col("id") < F.lit(first)
    return embedded.withColumn("v", F.when(before, F.col("v"))).withColumn(
        "error", F.when(before, F.col("error")).otherwise(F.coalesce(F.col("error"), F.lit("stopped"))))
