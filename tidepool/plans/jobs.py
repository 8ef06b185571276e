"""Composite jobs (what users call): import, embed, search, export, change, open.

Every job is set-based. The import replaces the original row-at-a-time loop by
one plan whose result equals the sequential rules:

* first-wins exact de-duplication = ``min(order key)`` per triple, minus the
  store's triples (anti join);
* ids = dense ranks of the accepted rows in line order, above the high-water mark;
* near-duplicates = best cosine against every vector with a smaller id (store
  ids are below every new id, so this is "store, or earlier in this load").
"""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions.text import embedding_text, is_blank, trim_trailing_newlines, ustrip
from tidepool.functions.vector import nonzero
from tidepool.operators.changes import apply_changes, save_embeddings, stamp_new
from tidepool.operators.dedup import anti_join_keys, first_wins
from tidepool.operators.embed import (
    BAD_DIMENSION,
    LETTERS,
    PER_ROW,
    Embedder,
    embed,
    embed_by_mode,
    letter_histogram,
)
from tidepool.operators.ids import assign_ids
from tidepool.operators.similarity import near_duplicates, top_k
from tidepool.schema import (
    ADDED,
    DUPLICATE,
    FIELDS,
    INVALID_STATUSES,
    KEY,
    NEAR_DUPLICATE_THRESHOLD,
    SEARCH_K,
    VALID,
)
from tidepool.session import stage, staging
from tidepool.sources.jsonl import ORDER_COLS, classify, non_blank, read_lines, write_jsonl
from tidepool.sources.store import Store, backfill_vectors, missing_vectors

log = logging.getLogger(__name__)
#: A task calls an embedder no more after that many batches in a row that failed whole.
BREAKER = 3
REPORT_SCHEMA = "added long, duplicate long, invalid long, near_duplicate long"


@dataclass
class ImportResult:
    status: DataFrame  # order key + status, one row per non-blank line
    added: DataFrame  # id, order key, fields of the accepted rows
    embedded: DataFrame  # id, v, error of the accepted rows
    near: DataFrame  # id, score of the near-duplicates
    records: DataFrame  # the store's records after the import
    vectors: DataFrame  # the store's vectors after the import
    report: DataFrame  # added, duplicate, invalid, near_duplicate
    high_water: int
    new_records: DataFrame  # only the rows added (what an append publishes)
    new_vectors: DataFrame  # only the vector rows added
    cached: tuple = ()  # persisted intermediates, released after publishing

    def release(self) -> None:
        for df in self.cached:
            df.unpersist()


def line_status(lines: DataFrame, order_cols=ORDER_COLS) -> DataFrame:
    """S2-P5 over non-blank lines: order key, status and fields."""
    return classify(non_blank(lines)).select(*order_cols, "status", "instruction", "input", "output", "source")


def import_lines(
    lines: DataFrame,
    records: DataFrame,
    vectors: DataFrame,
    high_water: int,
    as_of: dt.datetime,
    *,
    order_cols=ORDER_COLS,
    embedder: Embedder | None = letter_histogram,
    dim: int = LETTERS,
    threshold: float = NEAR_DUPLICATE_THRESHOLD,
    mode: str = PER_ROW,
    strategy: str = "auto",
    store_index: DataFrame | None = None,
    fetch: Callable[[DataFrame], DataFrame] | None = None,
    breaker: int | None = BREAKER,
    batch_rows: int | None = None,
) -> ImportResult:
    """J-IMPORT over a lines DataFrame ``(order cols..., line)``.

    ``embedder=None`` models an unavailable embedder: nothing is embedded and the
    near-duplicate count is 0, the import itself goes on. ``breaker`` and
    ``batch_rows`` are those of ``embed``; ``store_index`` and ``fetch`` those of ``anti_join_keys``.
    """
    order_cols = list(order_cols)
    # Classified lines feed the accepted rows, the status and the report.
    # The counts of the report also fill the cache: several query stages read it
    # concurrently and would otherwise each parse the lines before it exists.
    cls = line_status(lines, order_cols).persist()
    counts = cls.agg(F.count_if(F.col("status") == F.lit(VALID)).alias("valid"),
                     F.count_if(F.col("status").isin(*INVALID_STATUSES)).alias("invalid")).first()
    valid = cls.where(F.col("status") == F.lit(VALID))
    firsts = first_wins(valid, order_cols)
    new = anti_join_keys(firsts, records.select(*KEY), store_index, fetch)
    added, n_added = assign_ids(new, order_cols, high_water + 1)  # staged: stable on recompute

    flags = added.select(*order_cols, F.lit(True).alias("_added"))
    status = (
        cls.select(*order_cols, "status")
        .join(flags, order_cols, "left")
        .select(
            *order_cols,
            F.when(F.col("status") != F.lit(VALID), F.col("status"))
            .when(F.col("_added"), F.lit(ADDED))
            .otherwise(F.lit(DUPLICATE))
            .alias("status"),
        )
    )

    spark = lines.sparkSession
    if embedder is None or n_added == 0:
        embedded = spark.createDataFrame([], "id long, v array<double>, error string")
        near = spark.createDataFrame([], "id long, score double")
    else:
        texts = added.select("id", embedding_text("instruction", "input").alias("text"))
        # The model call is the expensive step: run it once, keep the result.
        embedded = embed_by_mode(texts, mode, embedder=embedder, dim=dim, breaker=breaker, batch_rows=batch_rows)
        new_vecs = embedded.where(F.col("v").isNotNull() & nonzero("v")).select("id", "v")
        pool = vectors.select("id", "v").unionByName(new_vecs)
        near = near_duplicates(pool, new_vecs.select("id"), threshold, strategy=strategy)

    with_emb = added.join(embedded.select("id", F.col("v").alias("embedding")), "id", "left")
    new_records = stamp_new(with_emb, as_of)
    records2 = records.select(*new_records.columns).unionByName(new_records)
    new_vectors = embedded.where(F.col("v").isNotNull() & nonzero("v")).select("id", "v")
    vectors2 = vectors.select("id", "v").unionByName(new_vectors)
    # The other counts are known, so the report reads the near-duplicates only.
    report = near.agg(
        F.lit(n_added).cast("long").alias("added"),
        F.lit(counts.valid - n_added).cast("long").alias("duplicate"),
        F.lit(counts.invalid).cast("long").alias("invalid"),
        F.count(F.lit(1)).alias("near_duplicate"),
    )
    return ImportResult(status, added, embedded, near, records2, vectors2, report,
                        high_water + n_added, new_records, new_vectors, (cls,))


def import_jsonl(store: Store, path: str | list[str], as_of: dt.datetime | None = None,
                 batch: int | None = None, **kw) -> DataFrame:
    """J-IMPORT from JSONL files into a store; publishes a new version and
    returns the one-row report."""
    spark = store.spark
    snap = store.current() or store.create(kw.get("dim", LETTERS))
    kw["dim"] = snap.dim or kw.get("dim", LETTERS)  # the store's dimension decides
    as_of = as_of or dt.datetime.now().replace(microsecond=0)
    return load_lines(store, snap, read_lines(spark, path), as_of, batch, **kw)


def load_lines(store: Store, snap, lines: DataFrame, as_of: dt.datetime, batch=None, **kw) -> DataFrame:
    """Import ``lines`` into the store's version ``snap``: publish, note the report in the ledger, release what was staged."""
    with staging(store.spark):
        res = import_lines(lines, store.records(), store.vectors(), snap.high_water, as_of,
                           store_index=store.key_index(), fetch=store.lookup, **kw)
        report = res.report.first().asDict()
        store.append(res.new_records, res.new_vectors, res.high_water, batch=batch, report=report)
        res.release()
    return store.spark.createDataFrame([tuple(report.values())], REPORT_SCHEMA)


def bootstrap_import(store: Store, path: str, as_of: dt.datetime | None = None, **kw) -> DataFrame:
    """Only for a store that did not exist yet, import ``path``; a missing
    or unreadable file gives a report of zeros."""
    spark = store.spark
    existed = store.exists()
    zeros = spark.createDataFrame([(0, 0, 0, 0)], REPORT_SCHEMA)
    store.create(kw.get("dim", LETTERS))
    if existed:
        return zeros
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        return zeros
    try:
        # Reading alone, with nothing written: only its failures give zeros.
        read_lines(spark, path).select("line").write.format("noop").mode("overwrite").save()
    except Exception as exc:  # noqa: BLE001 - what cannot be read, in whichever form Spark reports it
        log.warning("bootstrap file %s cannot be read: %s", path, exc)
        return zeros
    return import_jsonl(store, path, as_of, **kw)


def open_store(store: Store, dim: int, bootstrap_path: str | None = None,
               as_of: dt.datetime | None = None) -> Store:
    """J-OPEN: create when absent (S7) and, on that first opening only, import
    ``bootstrap_path`` (S6); migrate on read (E1); backfill vector rows from
    record embeddings (E2), publishing only when something changed."""
    if bootstrap_path is not None and not store.exists():
        bootstrap_import(store, bootstrap_path, as_of, dim=dim)
    store.create(dim)
    records = store.records()
    vectors = store.vectors()
    missing = missing_vectors(records, vectors).select("id")
    if not missing.isEmpty():
        store.rewrite(missing, lambda r, v: (r, backfill_vectors(r, v)))
    return store


def embed_pending(records: DataFrame, vectors: DataFrame, *, embedder: Embedder = letter_histogram,
                  dim: int = LETTERS, mode: str = PER_ROW, breaker: int | None = BREAKER,
                  batch_rows: int | None = None):
    """J-EMBED: embed every pending record; returns (records', vectors', report)
    with report columns succeeded, total."""
    pending = records.where(F.col("embedding").isNull())
    texts = pending.select("id", embedding_text("instruction", "input").alias("text"))
    # Stage the model output first: it is computed once whatever reads it next.
    embedded = embed_by_mode(texts, mode, embedder=embedder, dim=dim, breaker=breaker, batch_rows=batch_rows)
    good = embedded.where(F.col("v").isNotNull()).select("id", "v")
    r2, v2 = save_embeddings(records, vectors, good)
    report = embedded.agg(
        F.count_if(F.col("v").isNotNull()).alias("succeeded"), F.count(F.lit(1)).alias("total")
    )
    return r2, v2, report, embedded


def search(records: DataFrame, vectors: DataFrame, queries: DataFrame, *, k: int = SEARCH_K,
           embedder: Embedder = letter_histogram, dim: int = LETTERS, strategy: str = "auto") -> DataFrame:
    """J-SEARCH: ``queries(qid, text)`` -> ``(qid, rank, id, score)``.

    Blank queries are dropped (P11); each query is embedded (X1), the k best
    vectors are chosen first and only then joined with the records (J1), so a
    vector without a record still uses up a place, as in the original. An
    embedder of another dimension than ``dim`` raises.
    """
    q = queries.where(~is_blank("text")).select(F.col("qid").alias("id"), ustrip("text").alias("text"))
    # One model call per query, whatever plan the search then takes.
    qv = stage(embed(q, embedder=embedder, dim=dim), "query-vectors")
    if not qv.where(F.col("error") == F.lit(BAD_DIMENSION)).isEmpty():
        raise ValueError(f"the embedder's vectors have not the store's dimension {dim}")
    qv = qv.where(F.col("v").isNotNull())
    best = top_k(vectors, qv, k, strategy=strategy)
    return best.join(records.select("id"), "id", "inner").select("qid", "rank", "id", "score")


def export_jsonl(records: DataFrame, path: str, one_file: bool = False) -> int:
    """J-EXPORT / K1."""
    return write_jsonl(records, path, one_file)


def change(records: DataFrame, vectors: DataFrame, changes: DataFrame, as_of: dt.datetime,
           order_col: str | None = None):
    """J-CHANGE."""
    return apply_changes(records, vectors, changes, as_of, order_col)


# --- the same jobs against a store: read the current version, publish the next

def embed_store(store: Store, *, embedder: Embedder = letter_histogram, dim: int | None = None,
                mode: str = PER_ROW, breaker: int | None = BREAKER) -> DataFrame:
    """J-EMBED on a store: the pending records are embedded once (staged), then
    only the segments holding them are rewritten. Returns the report."""
    snap = store._require()
    d = dim or snap.dim or LETTERS
    texts = store.pending().select("id", embedding_text("instruction", "input").alias("text"))
    with staging(store.spark):
        embedded = embed_by_mode(texts, mode, embedder=embedder, dim=d, breaker=breaker)
        report = embedded.agg(F.count_if(F.col("v").isNotNull()).alias("succeeded"), F.count(F.lit(1)).alias("total")).first()
        good = embedded.where(F.col("v").isNotNull()).select("id", "v")
        if report.succeeded:
            store.rewrite(good.select("id"), lambda r, v: save_embeddings(r, v, good))
    return store.spark.createDataFrame([(report.succeeded, report.total)], "succeeded long, total long")


def change_store(store: Store, changes: DataFrame, as_of: dt.datetime | None = None,
                 order_col: str | None = None, trim_newlines: bool = False) -> None:
    """J-CHANGE on a store: updates, then deletes, in the segments they touch, and inserts in
    a segment of their own, published together as one version. An insert adds a record under a new id (its own is not read) without a
    duplicate check, as W1 does; one with a blank instruction or output is refused.
    Several changes of one id, and any insert, need ``order_col``. Another ``op``
    raises before anything is written."""
    from tidepool.operators.changes import OPS, delete, update

    as_of = as_of or dt.datetime.now().replace(microsecond=0)
    kinds = {r.op for r in changes.select("op").distinct().limit(len(OPS) + 1).collect()}
    if not kinds <= set(OPS):
        raise ValueError(f"unknown op in the changes: {sorted(map(str, kinds - set(OPS)))}")
    if "insert" in kinds and order_col is None:
        raise ValueError("inserts need an order column: it gives the order of their ids")
    ups = changes.where(F.col("op") == F.lit("update"))
    dels = changes.where(F.col("op") == F.lit("delete")).select("id")

    def apply(records: DataFrame, vectors: DataFrame):
        r1, v1 = update(records, vectors, ups, as_of, order_col, trim_newlines)
        return delete(r1, v1, dels)

    with staging(store.spark):
        added = _inserts(store, changes, as_of, order_col, trim_newlines) if "insert" in kinds else None
        store.rewrite(changes.where(F.col("op") != F.lit("insert")).select("id"), apply, added)


def _inserts(store: Store, changes: DataFrame, as_of: dt.datetime, order_col: str, trim_newlines: bool):
    """(records, vectors, high water) of a change set's inserts; None if it has none that count."""
    rows = changes.where(F.col("op") == F.lit("insert")).select(
        F.col(order_col).alias("_order"), *[F.coalesce(c, F.lit("")).alias(c) for c in FIELDS])
    if trim_newlines:
        rows = rows.select("_order", *[trim_trailing_newlines(c).alias(c) for c in FIELDS])
    rows = rows.where(~is_blank("instruction") & ~is_blank("output"))
    snap = store._require()
    added, n = assign_ids(rows, ["_order"], snap.high_water + 1)
    return (stamp_new(added, as_of), store.vectors().limit(0), snap.high_water + n) if n else None


def export_store(store: Store, path: str, one_file: bool = False) -> int:
    """J-EXPORT of the current version; returns the number of lines written."""
    return write_jsonl(store.records(), path, one_file)


def search_store(store: Store, queries: DataFrame, *, k: int = SEARCH_K,
                 embedder: Embedder = letter_histogram) -> DataFrame:
    """J-SEARCH against the current version."""
    snap = store._require()
    return search(store.records(), store.vectors(), queries, k=k, embedder=embedder,
                  dim=snap.dim or LETTERS)
