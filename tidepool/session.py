"""Session helpers: a local session for tests and the shared work folder.

On a cluster the work folder is whatever the cluster names in
``spark.checkpoint.dir`` (a shared file system). Only a local master may fall
back to a private temporary folder, which is what tests and the driver's
checks use.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

_LOCAL_DIR: str | None = None


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """The session used by tests and the benchmark (UI off, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidepool")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder; set a private one only on a local master."""
    global _LOCAL_DIR
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not _is_local(spark):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; a cluster job needs a shared folder"
        )
    if _LOCAL_DIR is None:
        _LOCAL_DIR = tempfile.mkdtemp(prefix="tidepool-ckpt-")
    sc.setCheckpointDir(_LOCAL_DIR)
    return sc.getCheckpointDir() or _LOCAL_DIR


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared work folder for staged tables."""
    root = checkpoint_root(spark)
    return os.path.join(root, "staged", f"{name}-{uuid.uuid4().hex[:12]}")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by Python workers (once per context).

    The zip is built in memory and written through the Hadoop FileSystem API
    into the shared work folder, so the same code works for a local folder and
    for HDFS or an object store; ``addPyFile`` then distributes it.
    """
    import io
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    target = f"{checkpoint_root(spark).rstrip('/')}/pylib/tidepool-{uuid.uuid4().hex[:8]}.zip"
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    try:
        out.write(bytearray(buf.getvalue()))
    finally:
        out.close()
    sc.addPyFile(target)
    _SHIPPED.add(key)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of a path in whatever store it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def spread(df, *keys: str):
    """Give a small input at least one partition per core.

    A large input already has a partition per file split, so this never adds
    a shuffle of big data: it only hash-partitions an input whose partition
    count is below the cluster's default parallelism (e.g. one row group). For file
    scans only: counting the partitions of a plan with a shuffle would run it.
    """
    sc = df.sparkSession.sparkContext
    want = sc.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *keys) if keys else df.repartition(want)


_SCOPES = threading.local()


@contextmanager
def staging(spark: SparkSession):
    """Tables staged inside are deleted at the end: a job that has published its result needs them no more."""
    if not hasattr(_SCOPES, "open"):
        _SCOPES.open = []
    _SCOPES.open.append([])
    try:
        yield
    finally:
        for path in _SCOPES.open.pop():
            fs, p = hadoop_path(spark, path)
            fs.delete(p, True)


def stage(df, name: str):
    """Cut lineage: write ``df`` as Parquet under the shared work folder and read it back.

    One job computes the data once (``checkpoint()`` without a cache computes it
    twice: once for the action, once for the checkpoint files). The written
    table survives lost executors; later stages read it instead of recomputing.
    """
    path = scratch_path(df.sparkSession, name)
    for paths in getattr(_SCOPES, "open", [])[-1:]:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
