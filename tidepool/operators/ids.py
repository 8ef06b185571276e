"""Dense, ordered id assignment without a single-task window.

Rows are range-partitioned and sorted on the order key, tagged with their
partition and position, and staged as a written table (so a lost executor
cannot change the numbering on recomputation). The per-partition counts form
a table of one row a partition; its running sums are broadcast and looked up
by a hash join. ``id = start + offset[partition] + position``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.session import stage


def assign_ids(
    df: DataFrame,
    order_cols: Sequence[str],
    start: int,
    id_col: str = "id",
    num_partitions: int | None = None,
) -> tuple[DataFrame, int]:
    """Number rows ``start, start+1, ...`` in order of ``order_cols`` (unique).

    Returns the numbered rows and their count.
    """
    # Without an explicit count AQE may coalesce the range partitions; it only
    # merges neighbours, so partition order is still key order.
    parted = (df.repartitionByRange(max(1, num_partitions), *order_cols) if num_partitions
              else df.repartitionByRange(*order_cols))
    ranged = (
        parted
        .sortWithinPartitions(*order_cols)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    staged = stage(ranged, "ids")
    # At most one row per range partition.
    counts = sorted(
        (r["_pid"], r["_n"], r["_m0"])
        for r in staged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0")).collect()
    )
    base, total = [], 0
    for pid, cnt, m0 in counts:
        base.append((pid, int(start) + total - int(m0)))
        total += int(cnt)
    if not base:
        return staged.drop("_pid", "_mid").withColumn(id_col, F.lit(None).cast("long")), 0
    offsets = df.sparkSession.createDataFrame(base, "_pid int, _base long")
    numbered = staged.join(F.broadcast(offsets), "_pid").withColumn(id_col, F.col("_base") + F.col("_mid"))
    return numbered.drop("_pid", "_mid", "_base"), total


def number_lines(lines: DataFrame, order_cols: Sequence[str], col: str = "line_no") -> DataFrame:
    """0-based position of each line in file order (S1 line numbers)."""
    return assign_ids(lines, order_cols, 0, id_col=col)[0]
