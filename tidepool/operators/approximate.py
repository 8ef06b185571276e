"""Opt-in approximate near-duplicates: random projections choose candidates, cosine verifies them.

MLlib's ``BucketedRandomProjectionLSH`` hashes unit vectors. ``rows`` consecutive hashes are
one band's key, so a pair is a candidate if all hashes of some band agree: a pair at cosine
0.93 does in about 0.965 of cases with the default parameters, a closer one more often, an
orthogonal one in about 0.06. Every candidate is checked with its exact cosine inside the
join, so what is returned is right; what is missing are pairs whose hashes never agreed. The
exact search (``similarity.near_duplicates``) remains the default everywhere.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions.vector import cosine
from tidepool.operators.similarity import _classes, _prepare
from tidepool.session import ship_package

BANDS = 12
ROWS = 4
BUCKET = 1.0  # width of a projection's bucket, on unit vectors
SEED = 20_011


def collision(distance: float, bucket: float = BUCKET) -> float:
    """The chance that one projection puts two points at this distance into one bucket."""
    r = bucket / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def expected_recall(score: float, bands: int = BANDS, rows: int = ROWS, bucket: float = BUCKET) -> float:
    """The chance that a pair with this cosine is a candidate."""
    if score >= 1.0:
        return 1.0
    return 1 - (1 - collision(math.sqrt(2 - 2 * score), bucket) ** rows) ** bands


def near_duplicates_approx(vectors: DataFrame, new_ids: DataFrame, threshold: float, *, ord_col: str | None = None,
                           bands: int = BANDS, rows: int = ROWS, bucket: float = BUCKET) -> DataFrame:
    """As ``similarity.near_duplicates`` with a positive threshold, but for rows whose near ones were no candidates.

    Equal vectors are one index row. Returns ``(id, score)``: the best score among a row's candidates.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    if threshold <= 0:
        raise ValueError("the approximate search needs a positive threshold")
    spark = vectors.sparkSession
    ship_package(spark)
    prepared = _prepare(vectors, "id", "v", ord_col)
    index = _classes(prepared).select("id", "v", "ord")
    queries = prepared.join(new_ids.select(F.col("id").cast("long")), "id", "left_semi")
    if index.isEmpty():
        return spark.createDataFrame([], "id long, score double")

    def unit(v: str) -> F.Column:
        # A power of two first, so that no square under- or overflows.
        top = F.array_max(F.transform(v, F.abs))
        scaled = F.transform(v, lambda x: x / top)
        return F.transform(scaled, lambda x: x / F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda a, y: a + y * y)))

    as_points = lambda df: df.withColumn("point", array_to_vector(unit("v")))
    lsh = BucketedRandomProjectionLSH(inputCol="point", outputCol="hashes", bucketLength=bucket, numHashTables=bands * rows, seed=SEED)
    model = lsh.fit(as_points(index).limit(1))  # reads the dimension only

    def banded(df: DataFrame) -> DataFrame:
        hashed = model.transform(as_points(df)).select("id", "v", "ord", F.expr("transform(hashes, h -> hash(h))").alias("h"))
        keys = F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(*[F.get("h", F.lit(b * rows + i)) for i in range(rows)]).alias("key")) for b in range(bands)])
        return hashed.select("id", "v", "ord", F.explode(keys).alias("k")).select("id", "v", "ord", "k.band", "k.key")

    q = banded(queries).select("band", "key", F.col("id").alias("qid"), F.col("v").alias("qv"), F.col("ord").alias("qord"))
    x = banded(index).select("band", "key", F.col("v").alias("xv"), F.col("ord").alias("xord"))
    # The exact score is part of the join, so only near pairs become rows.
    near = q.join(x, (q["band"] == x["band"]) & (q["key"] == x["key"]) & (F.col("xord") < F.col("qord")) & (cosine("qv", "xv") >= F.lit(threshold)))
    return near.groupBy(F.col("qid").alias("id")).agg(F.max(cosine("qv", "xv")).alias("score"))
