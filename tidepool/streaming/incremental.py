"""ST1: incremental import of JSONL files arriving in a directory.

Each micro-batch is one import into the store (the store is the state; no
``dropDuplicates`` state is kept). ``foreachBatch`` may replay a batch after a
failure, so the published snapshot records its ``batch_id`` and a batch that is
already published is skipped. Each batch's report is published with its version:
``Store.ledger()`` has a row for each stream (its checkpoint folder) and batch. Files are taken in arrival (modification-time)
order and, inside a batch, in path order.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.operators.embed import LETTERS
from tidepool.plans import jobs
from tidepool.sources.jsonl import ORDER_COLS
from tidepool.sources.store import Store


def import_stream(store: Store, in_dir: str, checkpoint_dir: str, *, as_of: dt.datetime | None = None,
                  max_files_per_trigger: int | None = None, **kw):
    """Run the stream until every available file is imported (availableNow).

    The store is created when absent; an existing one's vector dimension decides. Arrival order is the file source's
    (modification time); inside a batch, lines keep their path and line order.
    """
    spark = store.spark
    dim = store.create(kw.pop("dim", LETTERS)).dim
    reader = spark.readStream.format("text").option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    lines = reader.load(in_dir).select(
        F.col("_metadata.file_path").alias("src_file"),
        F.col("_metadata.file_block_start").alias("src_block"),
        F.col("value").alias("line"),
    )

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        snap = store.current()
        if snap is not None and snap.batch.get(checkpoint_dir, -1) >= batch_id:
            return  # replay of a published batch of this stream; another checkpoint counts for itself
        staged = batch.withColumn("src_row", F.monotonically_increasing_id()).select(
            *ORDER_COLS, "line"
        )
        jobs.load_lines(store, snap, staged, as_of or dt.datetime.now().replace(microsecond=0),
                   {checkpoint_dir: batch_id}, **{"dim": dim or LETTERS, **kw})

    query = (
        lines.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def stamp_arrival(spark, paths: list[str], start_ms: int = 1_600_000_000_000, step_ms: int = 1000) -> int:
    """Give the data files under ``paths`` strictly increasing modification
    times in (path, file name) order; returns the number of files stamped."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        fs = hp.getFileSystem(conf)
        files = sorted((st.getPath().getName(), st.getPath()) for st in fs.listStatus(hp)
                       if st.isFile() and not st.getPath().getName().startswith(("_", ".")))
        for _name, fp in files:
            fs.setTimes(fp, start_ms + n * step_ms, -1)
            n += 1
    return n
