"""What every operator of this package does with the session."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.session import ship_package, stage

__all__ = ["ready", "rows_that", "stage", "table", "text_input"]


def ready(spark: SparkSession) -> None:
    """Ship this package to the Python workers."""
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_input(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns an operator reads, whatever else the table holds."""
    kinds = {"doc_id": "long", "item_id": "long", "page_id": "long"}
    return docs.select(*[F.col(f"`{c}`").cast(kinds.get(c, "string")).alias(c) for c in columns])


def rows_that(docs: DataFrame, keep: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, pa.Array]]],
              extra: Callable[[DataFrame], DataFrame] = lambda d: d, reads: tuple[str, ...] = ("text",)) -> DataFrame:
    """Those rows of ``docs`` that ``keep`` marks, with all their columns: each row has its own verdict, whatever its doc_id.

    ``keep`` yields batches, which have the columns ``reads`` by their names, and a flag for each row;
    ``extra`` adds columns for it that are dropped again.
    """
    ready(docs.sparkSession)
    names = docs.columns
    # Any column name can pass, one with a dot too.
    plain = docs.toDF(*[c if c in reads else f"c{i}" for i, c in enumerate(names)])
    out = plain.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, flags in keep(batches):
            yield batch.select(out).filter(flags)

    return extra(plain).mapInArrow(run, plain.schema).toDF(*names)
