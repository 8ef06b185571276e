"""Scenario tables derived from the driver's parquet tables.

Each is built from a whole table (``documents`` or ``embeddings``), so its size
grows with the scale factor. The same definitions exist as DuckDB SQL in
``tidepool.catalog_sql`` for the oracle.

fx_src      documents split into (instruction, input, output, source)
fx_docs     every document with an output as a stored record (id = doc_id + 1)
fx_all_lines  every document as a JSONL line, one line kind per doc_id % 40
fx_store    of fx_docs every tenth: the store that the import queries load into
fx_lines    the lines of the other documents: what they load
fx_vec      embeddings plus near / far copies and zero vectors
fx_records  fx_docs with timestamps and embeddings (some zero, some pending)
fx_index    vector rows of part of fx_records (the rest must be backfilled)
fx_changes  deletes and edits (two edits of each id, in order of seq), plus two unknown ids
fx_new_vec  replacement vectors for records (every id % 4 = 3 a zero vector),
            two of each id in order of seq
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.session import spread

FIXED_TS = "2020-01-01 00:00:00"
DEEP = 20_000  # levels of a line nested too deep
STORE_ORDER = -1  # order value of store rows in the near-duplicate scenario


# Text-heavy tables: spread over the cores when the file has fewer splits.
SPREAD = {"documents": "doc_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df, SPREAD[name]) if name in SPREAD else df


def fx_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    first = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    return d.select(
        "doc_id",
        (F.col("doc_id") % 40).alias("k"),
        first.alias("instruction"),
        F.when(F.col("lang") == "en", F.lit("")).otherwise(F.col("lang")).alias("input"),
        F.when(
            F.col("text").contains("\n"),
            F.expr("substr(text, char_length(split_part(text, '\n', 1)) + 2)"),
        ).otherwise(F.lit("")).alias("output"),
        "source",
    )


def fx_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx_src(spark, sf_dir)
    return s.where(F.trim("output") != "").select(
        (F.col("doc_id") + 1).alias("id"), "instruction", "input", "output", "source"
    )


def fx_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx_docs(spark, sf_dir).where((F.col("id") - 1) % 10 == 0)


def _obj(*pairs) -> F.Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in pairs]), {"ignoreNullFields": "false"})


def fx_all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx_src(spark, sf_dir)
    ins, inp, out, src = F.col("instruction"), F.col("input"), F.col("output"), F.col("source")
    k = F.col("k")
    full = _obj(("instruction", ins), ("input", inp), ("output", out), ("source", src))
    line = (
        F.when(k == 1, F.concat(F.lit("{broken"), F.col("doc_id").cast("string")))
        .when(k == 2, F.lit("[1,2,3]"))
        .when(k == 3, _obj(("instruction", F.col("doc_id")), ("input", F.lit("")), ("output", out)))
        .when(k == 4, _obj(("instruction", ins), ("input", inp), ("output", F.lit("   "))))
        .when(k == 5, _obj(("instruction", ins), ("input", F.lit(None).cast("string")), ("output", out)))
        .when(k == 6, F.concat(_obj(("instruction", ins), ("input", inp), ("output", out)), F.lit(" trailing")))
        .when(k == 7, F.lit("   "))
        .when(k == 8, _obj(("instruction", ins), ("output", out)))
        .when(k == 9, F.concat(F.lit("  "), full, F.lit("  ")))
        .when((k == 12) & (F.col("doc_id") % 200 == 12), F.lit('{"instruction":"a","output":"b","x":' + "[" * DEEP + "]" * DEEP + "}"))
        .when(k == 11, _obj(("instruction", F.lit("　")), ("input", inp), ("output", out)))
        .otherwise(full)
    )
    return s.select(F.col("doc_id").alias("line_no"), line.alias("line"))


def fx_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx_all_lines(spark, sf_dir).where(F.col("line_no") % 10 != 0)


def fx_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("e")
    )
    rest = F.slice("e", 2, F.size("e") - 1)
    # id = vec_id * 4 + kind: ids of different vectors never meet, however many there are.
    base = e.select((F.col("vec_id") * 4).alias("id"), F.col("e").alias("v"), F.lit("base").alias("kind"))
    near = e.where(F.col("vec_id") % 5 == 0).select(
        (F.col("vec_id") * 4 + 1).alias("id"),
        F.concat(F.array(F.get("e", 0) + F.lit(0.2)), rest).alias("v"), F.lit("near").alias("kind"),
    )
    far = e.where(F.col("vec_id") % 5 == 1).select(
        (F.col("vec_id") * 4 + 2).alias("id"),
        F.concat(F.array(F.get("e", 0) + F.lit(0.6)), rest).alias("v"), F.lit("far").alias("kind"),
    )
    zero = e.where(F.col("vec_id") % 50 == 2).select(
        (F.col("vec_id") * 4 + 3).alias("id"),
        F.transform("e", lambda x: F.lit(0.0)).alias("v"), F.lit("zero").alias("kind"),
    )
    return base.unionByName(near).unionByName(far).unionByName(zero)


def fx_vec_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_vec with the import scenario's order: store rows (the base vectors of
    even vec_id) come first, the new rows follow in id order."""
    v = fx_vec(spark, sf_dir)
    is_store = F.col("id") % 8 == 0
    return v.withColumn("is_store", is_store).withColumn(
        "ord", F.when(is_store, F.lit(STORE_ORDER)).otherwise(F.col("id"))
    )


def fx_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx_docs(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    ts = F.lit(FIXED_TS).cast("timestamp_ntz")
    emb = (
        F.when((F.col("id") - 1) % 100 == 40, F.transform("e", lambda x: F.lit(0.0)))
        .when((F.col("id") - 1) % 20 != 7, F.col("e"))
    )
    return s.join(e, e.vec_id == s.id - 1, "left").select(
        F.col("id").cast("long"), "instruction", "input", "output", "source",
        ts.alias("created_at"), ts.alias("updated_at"), emb.alias("embedding"),
    )


def fx_index(spark: SparkSession, sf_dir: str, records: DataFrame | None = None) -> DataFrame:
    r = records if records is not None else fx_records(spark, sf_dir)
    return r.where(((F.col("id") - 1) % 2 == 0) & F.exists("embedding", lambda x: x != 0)).select(
        "id", F.col("embedding").alias("v")
    )


def fx_changes(spark: SparkSession, sf_dir: str, records: DataFrame | None = None) -> DataFrame:
    r = records if records is not None else fx_records(spark, sf_dir)
    null = F.lit(None).cast("string")
    dels = r.where((F.col("id") - 1) % 30 == 0).select(
        "id", F.lit("delete").alias("op"), null.alias("instruction"), null.alias("input"),
        null.alias("output"), null.alias("source"), F.lit(1).alias("seq"),
    )
    ups = r.where((F.col("id") - 1) % 50 == 10).select(
        "id", F.lit("update").alias("op"), F.concat("instruction", F.lit(" (edited)")).alias("instruction"),
        "input", "output", "source", F.lit(3).alias("seq"),
    )
    earlier = ups.withColumns({"instruction": F.concat(F.lit("~ "), F.col("instruction")), "seq": F.lit(2)})
    extra = spark.createDataFrame(
        [(-1, "delete", None, None, None, None, 1), (-2, "update", "x", "", "y", "", 2)],
        "id long, op string, instruction string, input string, output string, source string, seq int",
    )
    return dels.unionByName(earlier).unionByName(ups).unionByName(extra)


def fx_new_vec(spark: SparkSession, sf_dir: str, records: DataFrame | None = None) -> DataFrame:
    r = (records if records is not None else fx_records(spark, sf_dir)).select("id")
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    v = F.when(F.col("id") % 4 == 3, F.transform("e", lambda x: F.lit(0.0))).otherwise(F.col("e"))
    return r.join(e, e.vec_id == r.id, "inner").select(
        "id", F.explode(F.array(F.struct(F.transform(v, lambda x: x + F.lit(1.0)).alias("v"), F.lit(1).alias("seq")),
                                F.struct(v.alias("v"), F.lit(2).alias("seq")))).alias("n")).select("id", "n.v", "n.seq")
