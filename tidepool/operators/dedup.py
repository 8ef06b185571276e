"""Exact de-duplication on the (instruction, input, output) triple.

D1  first-wins within one load (keeps the earliest line and its source),
J3  anti join against the store's keys,
A3  distinct triples.

Both are aggregations or joins on the key, so a hot triple is collapsed on the
map side (partial aggregation) before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.schema import KEY
from tidepool.session import stage

PREFIX_BITS = 4


def key_hash(cols: Sequence[str] = KEY):
    """64-bit hash of the key; used only to prune, never to decide equality."""
    return F.xxhash64(*[F.col(c) for c in cols])


def distinct_keys(records: DataFrame) -> DataFrame:
    """A3 / S3: the set of triples in the store (source ignored)."""
    return records.select(*KEY).distinct()


def first_wins(rows: DataFrame, order_cols: Sequence[str], carry: Sequence[str] = ("source",)) -> DataFrame:
    """One row per triple, the one with the smallest order key.

    ``min(struct(order..., carry...))`` is an ordinary aggregate, so each map task
    keeps one row per triple before the shuffle: a triple repeated in a third of
    the input costs one row per task, not a third of the data in one task.
    """
    packed = F.struct(*[F.col(c) for c in order_cols], *[F.col(c) for c in carry])
    # The key hash leads the grouping: the sort behind the aggregate orders on a
    # 64-bit prefix and compares the texts only when hashes are equal.
    firsts = rows.groupBy(key_hash().alias("_h"), *KEY).agg(F.min(packed).alias("_first"))
    return firsts.select(
        *KEY,
        *[F.col("_first").getField(c).alias(c) for c in order_cols],
        *[F.col("_first").getField(c).alias(c) for c in carry],
    )


def prefix_of(hash_col: str) -> F.Column:
    """The leading bits of a key hash, as a number from 0; the partition column of a stored key index."""
    return F.shiftrightunsigned(F.col(hash_col), 64 - PREFIX_BITS).cast("int")


def key_hits(index: DataFrame, hashed: DataFrame) -> DataFrame:
    """(id if the index has it, _h): the index rows whose hash some row of ``hashed`` (_h, _prefix) has.

    The join is on prefix and hash: where the index lies in folders by prefix, those without a row
    of ``hashed`` are not read (dynamic partition pruning).
    """
    wanted = hashed.select("_prefix", "_h").distinct().where(F.col("_prefix") >= 0)
    return index.join(wanted, ["_prefix", "_h"], "left_semi").drop("_prefix")


def anti_join_keys(rows: DataFrame, store: DataFrame, store_index: DataFrame | None = None,
                   fetch: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows whose triple is not in ``store``.

    Hash prefilter, planned so that a large store is scanned but never shuffled:
    the store's hashes are semi-joined with the distinct hashes of the incoming
    rows (the small side, which Spark can broadcast), leaving only the store
    hashes that some incoming row shares. Rows without such a hash are new
    without a text compare; the others are checked against the store's full
    triples, so a hash collision can never drop a row. The incoming rows and the hits are
    staged, so both are computed once.

    ``store_index`` (``id``, ``_h``, ``_prefix``: the hashes a store keeps) and ``fetch``
    (ids -> records) let the check read the texts of only the store rows whose
    hash matches, instead of scanning every stored text.
    """
    hashed = lambda df: df.withColumn("_h", key_hash()).withColumn("_prefix", prefix_of("_h"))
    cand = stage(hashed(rows), "import-keys")
    index = store_index if store_index is not None else hashed(store).select("_h", "_prefix")
    hits = stage(key_hits(index, cand), "key-hits")
    hit_h = hits.select("_h").distinct().withColumn("_hit", F.lit(True))
    flagged = cand.drop("_prefix").join(hit_h, "_h", "left")
    sure_new = flagged.where(F.col("_hit").isNull())
    maybe = flagged.where(F.col("_hit"))
    if store_index is not None and fetch is not None:
        same_hash = fetch(hits.select("id")).select(*KEY).distinct()
    else:
        same_hash = store.withColumn("_h", key_hash()).join(hit_h, "_h", "left_semi").select(*KEY).distinct()
    checked = maybe.join(same_hash, list(KEY), "left_anti")
    return sure_new.unionByName(checked).drop("_h", "_hit")
