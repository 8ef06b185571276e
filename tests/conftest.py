from __future__ import annotations

import os
import sys
import tempfile

import pytest
from pyspark import cloudpickle

# Test embedders live here; ship them to Python workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from tidepool.session import local_session

    s = local_session(cores=4, shuffle_partitions=8)
    yield s


@pytest.fixture()
def tmp_root():
    return tempfile.mkdtemp(prefix="tidepool-test-")


def lines_df(spark, lines):
    return spark.createDataFrame([(i, l) for i, l in enumerate(lines)], "line_no long, line string")


def empty_store(spark):
    from tidepool.schema import RECORD_SCHEMA

    return (spark.createDataFrame([], RECORD_SCHEMA),
            spark.createDataFrame([], "id long, v array<double>"))


def records_df(spark, rows):
    """rows: (id, instruction, input, output, source, embedding or None)."""
    import datetime as dt

    from tidepool.schema import RECORD_SCHEMA

    ts = dt.datetime(2020, 1, 1)
    data = [(i, a, b, c, d, ts, ts, e) for i, a, b, c, d, e in rows]
    return spark.createDataFrame(data, RECORD_SCHEMA)


def table_embedder(mapping: dict[str, list[float]], dim: int):
    """Test embedder: text -> fixed vector (zero vector when unknown)."""
    import pyarrow as pa

    def run(batch):
        texts = batch.column(1).to_pylist()
        vecs = [list(map(float, mapping.get(t, [0.0] * dim))) for t in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(vecs, pa.list_(pa.float64())), pa.nulls(len(texts), pa.string())],
            names=["id", "v", "error"],
        )

    return run


def failing_embedder(batch):
    import pyarrow as pa

    n = batch.num_rows
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.nulls(n, pa.list_(pa.float64())), pa.array(["down"] * n)],
        names=["id", "v", "error"],
    )
