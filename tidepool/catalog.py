"""Registered queries: one per operator of the inventory, over the driver tables.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame. Scores are
rounded to 6 decimals at the output only; timestamps are rendered as text.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import text as T
from tidepool.functions import vector as V
from tidepool.operators import changes as C
from tidepool.operators.dedup import distinct_keys
from tidepool.operators.embed import FAIL_STOP, PER_ROW, embed, flaky, letter_histogram
from tidepool.operators.ids import number_lines
from tidepool.operators.similarity import max_similarity, near_duplicates, top_k
from tidepool.plans import fixtures as fx
from tidepool.plans import jobs
from tidepool.schema import NEAR_DUPLICATE_THRESHOLD, SEARCH_K
from tidepool.session import scratch_path, ship_package, stage
from tidepool.sources import jsonl as J
from tidepool.sources import store as S

AS_OF = dt.datetime(2021, 6, 1, 12, 0, 0)
FAIL_EVERY = 37
TS_FMT = "yyyy-MM-dd HH:mm:ss"


def _r6(c) -> F.Column:
    return F.round(c, 6)


def _ts(c: str) -> F.Column:
    return F.date_format(F.col(c), TS_FMT).alias(c)


def _digest(v: str, prefix: str = "v") -> list[F.Column]:
    dim = F.when(F.col(v).isNotNull(), F.size(v)).cast("long")
    return [dim.alias(f"{prefix}_dim"), _r6(V.component_sum(v)).alias(f"{prefix}_sum"), _items(F.col(v)).alias(f"{prefix}_items")]


def _items(v: F.Column) -> F.Column:
    """Every component in millionths, as text."""
    return F.array_join(F.transform(v, lambda x: F.round(x * F.lit(1e6)).cast("long").cast("string")), ",")


# --- import over fx_lines into fx_store -----------------------------------

_STORES: dict = {}


def _records(spark, sf) -> DataFrame:
    """fx_records as a written table (the store the change operators act on)."""
    key = ("records", spark.sparkContext.applicationId, sf)
    if key not in _STORES:
        _STORES[key] = stage(fx.fx_records(spark, sf), "fx-records")
    return _STORES[key]


def _index(spark, sf) -> DataFrame:
    return fx.fx_index(spark, sf, _records(spark, sf))


def _changes(spark, sf) -> DataFrame:
    return fx.fx_changes(spark, sf, _records(spark, sf))


def _store_records(spark, sf, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """fx_store (``whole``: fx_docs) as a written store: every row embedded with the letter histogram.

    The records table is staged once per session; its vectors derive from it.
    """
    key = ("store", whole, spark.sparkContext.applicationId, sf)
    if key not in _STORES:
        _STORES[key] = _embedded_store(spark, sf, whole)
    records = _STORES[key]
    vectors = records.where(F.col("embedding").isNotNull() & V.nonzero("embedding")).select(
        "id", F.col("embedding").alias("v"))
    return records, vectors


def prepare(spark, sf) -> None:
    """Write the fixture stores (what exists before any operator runs)."""
    _records(spark, sf)
    _store_records(spark, sf)
    _store_records(spark, sf, whole=True)


def _embedded_store(spark, sf, whole: bool) -> DataFrame:
    s = fx.fx_docs(spark, sf) if whole else fx.fx_store(spark, sf)
    ts = F.lit(fx.FIXED_TS).cast("timestamp_ntz")
    pending = s.select(F.col("id").cast("long"), "instruction", "input", "output", "source",
                       ts.alias("created_at"), ts.alias("updated_at"),
                       F.lit(None).cast("array<double>").alias("embedding"))
    empty_v = spark.createDataFrame([], "id long, v array<double>")
    r, _v, _rep, _emb = jobs.embed_pending(pending, empty_v)
    return stage(r, "fx-store-records")


def _high_water(records: DataFrame) -> int:
    """The fixture store's high-water mark (it has no deletes: its largest id)."""
    return int(records.agg(F.max("id")).first()[0] or 0)


_IMPORT_CACHE: dict = {}


def _import(spark, sf) -> jobs.ImportResult:
    """J-IMPORT of fx_lines (ordered by line number) into the embedded fx_store."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _IMPORT_CACHE:
        records, vectors = _store_records(spark, sf)
        _IMPORT_CACHE[key] = jobs.import_lines(fx.fx_lines(spark, sf), records, vectors,
                                               _high_water(records), AS_OF, order_cols=["line_no"])
    return _IMPORT_CACHE[key]


def q_jsonl_line_status(spark, sf):
    return jobs.line_status(fx.fx_all_lines(spark, sf), ["line_no"]).select("line_no", "status")


def q_import_status(spark, sf):
    return _import(spark, sf).status.select("line_no", "status")


def q_import_records(spark, sf):
    return _import(spark, sf).added.select("line_no", "instruction", "input", "output", "source")


def q_import_duplicates(spark, sf):
    return _import(spark, sf).status.where(F.col("status") == "duplicate").select("line_no")


def q_import_assigned_ids(spark, sf):
    return _import(spark, sf).added.select("line_no", "id")


def q_import_report(spark, sf):
    return _import(spark, sf).report


def q_import_near_duplicates(spark, sf):
    return _import(spark, sf).near.select("id", _r6("score").alias("score"))


def _write_lines(spark, sf, name: str) -> str:
    path = scratch_path(spark, name)
    fx.fx_all_lines(spark, sf).orderBy("line_no").select(F.col("line").alias("value")).write.text(path)
    return path


def q_jsonl_lines(spark, sf):
    """S1 + P1 over a real JSONL file: 0-based physical line number, stripped line."""
    path = _write_lines(spark, sf, "fx-lines")
    numbered = number_lines(J.read_lines(spark, path), list(J.ORDER_COLS))
    return J.non_blank(numbered).select("line_no", "line")


def q_bootstrap_import(spark, sf):
    path = _write_lines(spark, sf, "bootstrap")
    store = S.Store(spark, scratch_path(spark, "bootstrap-store"))
    return jobs.bootstrap_import(store, path, AS_OF)


def _streamed(spark, sf) -> S.Store:
    """fx_store after the stream has taken fx_lines in three deliveries."""
    from tidepool.streaming.incremental import import_stream, stamp_arrival

    root = scratch_path(spark, "incoming")
    lines = fx.fx_lines(spark, sf)
    top = lines.agg(F.max("line_no")).first()[0] or 0
    part = F.floor(F.col("line_no") * 3 / F.lit(top + 1)).cast("int")
    for i in range(3):  # three deliveries arriving one after the other
        (lines.where(part == i).orderBy("line_no").select(F.col("line").alias("value"))
         .write.text(f"{root}/in/{i:05d}"))
    n_files = stamp_arrival(spark, [f"{root}/in/{i:05d}" for i in range(3)])
    store = S.Store(spark, f"{root}/store")
    records, vectors = _store_records(spark, sf)
    hw = _high_water(records)
    store.publish(records, vectors, hw, batch=-1, dim=26)
    # About three micro-batches; any batching gives the same store.
    import_stream(store, f"{root}/in", f"{root}/checkpoint", as_of=AS_OF,
                  max_files_per_trigger=max(1, -(-n_files // 3)))
    return store


def q_incremental_import(spark, sf):
    return _streamed(spark, sf).records().select("id", "instruction", "input", "output", "source")


def q_incremental_ledger(spark, sf):
    """ST1: the stream's ledger, its batches taken together."""
    counts = ("added", "duplicate", "invalid", "near_duplicate")
    return _streamed(spark, sf).ledger().agg(*[F.sum(c).alias(c) for c in counts])


# --- store reads ------------------------------------------------------------

def q_existing_keys(spark, sf):
    return distinct_keys(fx.fx_docs(spark, sf))


def q_record_listing(spark, sf):
    return S.listing(fx.fx_docs(spark, sf))


def q_preview(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", T.preview("text").alias("preview"))


def q_record_lookup(spark, sf):
    r = S.lookup(_records(spark, sf), _changes(spark, sf).select("id"))
    return r.select("id", "instruction", "input", "output", "source", _ts("created_at"),
                    _ts("updated_at"), F.col("embedding").isNotNull().alias("has_embedding"))


def q_schema_migration(spark, sf):
    legacy = fx.fx_docs(spark, sf).select(
        "id", "instruction", "input", "output",
        F.lit(fx.FIXED_TS).cast("timestamp_ntz").alias("created_at"),
        F.lit(fx.FIXED_TS).cast("timestamp_ntz").alias("updated_at"),
    )
    m = S.migrate(legacy)
    return m.select("id", "instruction", "input", "output", "source", _ts("created_at"),
                    _ts("updated_at"), F.col("embedding").isNull().alias("pending"))


def q_vector_backfill(spark, sf):
    v = S.backfill_vectors(_records(spark, sf), _index(spark, sf))
    return v.select("id", *_digest("v"))


def q_pending_records(spark, sf):
    return _records(spark, sf).where(F.col("embedding").isNull()).select("id", "instruction", "input")


def q_embedding_text(spark, sf):
    r = _records(spark, sf)
    return r.select("id", T.embedding_text("instruction", "input").alias("text"))


def q_nonzero_vectors(spark, sf):
    return fx.fx_vec(spark, sf).where(V.nonzero("v")).select("id")


# --- store changes ------------------------------------------------------------

def _vec_flag(records: DataFrame, vectors: DataFrame) -> DataFrame:
    flagged = vectors.select("id", F.lit(True).alias("_v"))
    return records.join(flagged, "id", "left").withColumn("has_vec", F.coalesce("_v", F.lit(False))).drop("_v")


def q_update_records(spark, sf):
    ch = _changes(spark, sf).where(F.col("op") == "update")
    r, v = C.update(_records(spark, sf), _index(spark, sf), ch, AS_OF, "seq")
    return _vec_flag(r, v).select("id", "instruction", "input", "output", "source", _ts("updated_at"),
                                  F.col("embedding").isNotNull().alias("has_embedding"), "has_vec")


def q_delete_records(spark, sf):
    ids = _changes(spark, sf).where(F.col("op") == "delete").select("id")
    r, v = C.delete(_records(spark, sf), _index(spark, sf), ids)
    return _vec_flag(r, v).select("id", "instruction", "input", "output", "source", _ts("updated_at"),
                                  F.col("embedding").isNotNull().alias("has_embedding"), "has_vec")


def q_apply_changes(spark, sf):
    r, v = jobs.change(_records(spark, sf), _index(spark, sf), _changes(spark, sf), AS_OF, "seq")
    return _vec_flag(r, v).select("id", "instruction", "input", "output", "source", _ts("updated_at"),
                                  F.col("embedding").isNotNull().alias("has_embedding"), "has_vec")


def q_save_embeddings(spark, sf):
    r, v = C.save_embeddings(_records(spark, sf), _index(spark, sf), fx.fx_new_vec(spark, sf, _records(spark, sf)), "seq")
    return _vec_flag(r, v).select("id", *_digest("embedding", "emb"), "has_vec")


def q_upsert_vectors(spark, sf):
    v = C.upsert_vectors(_index(spark, sf), fx.fx_new_vec(spark, sf, _records(spark, sf)), "seq")
    return v.select("id", *_digest("v"))


def q_clear_vectors(spark, sf):
    ids = _changes(spark, sf).where(F.col("op") == "delete").select("id")
    return C.clear_vectors(_index(spark, sf), ids).select("id", *_digest("v"))


# --- scalar functions --------------------------------------------------------

def q_vector_codec(spark, sf):
    e = fx.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    back = V.decode(V.encode("v"))
    return e.select("vec_id", F.size(back).cast("long").alias("dim"), (back == F.col("v")).alias("roundtrip_ok"), _items(back).alias("items"))


def _pairs(spark, sf) -> DataFrame:
    v = fx.fx_vec(spark, sf)
    base = v.where(F.col("kind") == "base").select(F.col("id").alias("b"), F.col("v").alias("bv"))
    copies = v.where(F.col("kind") != "base").select(F.col("id").alias("a"), F.col("v").alias("av"))
    return copies.join(base, F.col("a") - F.col("a") % 4 == F.col("b")).select(
        "a", "b", V.cosine("av", "bv").alias("score")
    )


def q_cosine_pairs(spark, sf):
    return _pairs(spark, sf).select("a", "b", _r6("score").alias("score"))


def q_score_format(spark, sf):
    return _pairs(spark, sf).select("a", "b", T.score_format("score").alias("score_text"))


def q_trim_trailing_newlines(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", T.trim_trailing_newlines("text").alias("value"))


# --- similarity ----------------------------------------------------------------

def _topk_out(df: DataFrame) -> DataFrame:
    return df.select("qid", F.col("rank").cast("long"), "id", _r6("score").alias("score"))


def q_cosine_top_k(spark, sf):
    v = fx.fx_vec(spark, sf)
    query = v.where(F.col("id") == 1)
    return _topk_out(top_k(v, query, SEARCH_K))


def q_cosine_top_k_batch(spark, sf):
    v = fx.fx_vec(spark, sf)
    queries = v.where(F.col("kind").isin("near", "far"))
    index = v.where(F.col("kind") == "base")
    return _topk_out(top_k(index, queries, SEARCH_K, strategy="grid"))


def q_max_similarity(spark, sf):
    v = fx.fx_vec(spark, sf)
    queries = v.where(F.col("id") % 8 >= 4)
    index = v.where(F.col("id") % 8 < 4)
    best = max_similarity(index, queries)
    return best.select(F.col("qid").alias("id"), _r6("score").alias("score"))


def q_near_duplicates(spark, sf):
    v = fx.fx_vec_scenario(spark, sf)
    new = v.where(~F.col("is_store")).select("id")
    near = near_duplicates(v, new, NEAR_DUPLICATE_THRESHOLD, ord_col="ord")
    return near.select("id", _r6("score").alias("score"))


# --- embedder jobs -------------------------------------------------------------

def _pending_store(spark, sf) -> DataFrame:
    s = fx.fx_docs(spark, sf)
    ts = F.lit(fx.FIXED_TS).cast("timestamp_ntz")
    return s.select(F.col("id").cast("long"), "instruction", "input", "output", "source",
                    ts.alias("created_at"), ts.alias("updated_at"),
                    F.lit(None).cast("array<double>").alias("embedding"))


def q_embed_records(spark, sf):
    p = _records(spark, sf).where(F.col("embedding").isNull())
    e = embed(p.select("id", T.embedding_text("instruction", "input").alias("text")))
    return e.select("id", *_digest("v"), V.dot("v", "v").alias("v_sq"))


def q_search_by_text(spark, sf):
    records, vectors = _store_records(spark, sf, whole=True)
    queries = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return _topk_out(jobs.search(records, vectors, queries, k=SEARCH_K))


def q_embed_fail_stop(spark, sf):
    empty_v = spark.createDataFrame([], "id long, v array<double>")
    _r, _v, _rep, emb = jobs.embed_pending(_pending_store(spark, sf), empty_v,
                                           embedder=flaky(letter_histogram, FAIL_EVERY), mode=FAIL_STOP)
    return emb.select("id", F.col("v").isNotNull().alias("embedded"))


def q_embed_report(spark, sf):
    empty_v = spark.createDataFrame([], "id long, v array<double>")
    _r, _v, rep, _emb = jobs.embed_pending(_pending_store(spark, sf), empty_v,
                                           embedder=flaky(letter_histogram, FAIL_EVERY), mode=PER_ROW)
    return rep


# --- export ----------------------------------------------------------------------

def q_export_roundtrip(spark, sf):
    path = scratch_path(spark, "export")
    jobs.export_jsonl(_records(spark, sf), path)
    lines = number_lines(J.read_lines(spark, path), list(J.ORDER_COLS))
    back = jobs.line_status(lines, ["line_no"])
    return back.where(F.col("status") == "valid").select("line_no", "instruction", "input", "output", "source")


_REGISTERED: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "import_report": q_import_report,
    "jsonl_lines": q_jsonl_lines,
    "jsonl_line_status": q_jsonl_line_status,
    "import_status": q_import_status,
    "import_records": q_import_records,
    "import_duplicates": q_import_duplicates,
    "import_assigned_ids": q_import_assigned_ids,
    "import_near_duplicates": q_import_near_duplicates,
    "bootstrap_import": q_bootstrap_import,
    "incremental_import": q_incremental_import,
    "incremental_ledger": q_incremental_ledger,
    "existing_keys": q_existing_keys,
    "record_listing": q_record_listing,
    "preview": q_preview,
    "record_lookup": q_record_lookup,
    "schema_migration": q_schema_migration,
    "vector_backfill": q_vector_backfill,
    "pending_records": q_pending_records,
    "embedding_text": q_embedding_text,
    "nonzero_vectors": q_nonzero_vectors,
    "update_records": q_update_records,
    "delete_records": q_delete_records,
    "apply_changes": q_apply_changes,
    "save_embeddings": q_save_embeddings,
    "upsert_vectors": q_upsert_vectors,
    "clear_vectors": q_clear_vectors,
    "vector_codec": q_vector_codec,
    "cosine_pairs": q_cosine_pairs,
    "score_format": q_score_format,
    "trim_trailing_newlines": q_trim_trailing_newlines,
    "cosine_top_k": q_cosine_top_k,
    "cosine_top_k_batch": q_cosine_top_k_batch,
    "max_similarity": q_max_similarity,
    "near_duplicates": q_near_duplicates,
    "embed_records": q_embed_records,
    "search_by_text": q_search_by_text,
    "embed_fail_stop": q_embed_fail_stop,
    "embed_report": q_embed_report,
    "export_roundtrip": q_export_roundtrip,
}


def _shipped(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Every query first makes the package importable on Python workers."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf)

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: _shipped(fn) for name, fn in _REGISTERED.items()
}


def reset_cache() -> None:
    """Forget staged import results (the benchmark times each query alone)."""
    _IMPORT_CACHE.clear()
