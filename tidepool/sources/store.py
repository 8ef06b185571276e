"""The record store: Parquet snapshots published through a pointer file.

Layout under ``root``::

    records/v=<n>/_block=<b>/  RECORD_SCHEMA + _key_hash (64-bit hash of the triple)
                               + _pending (no embedding yet), by block of ids
    vectors/v=<n>/             VECTOR_SCHEMA (id, v): non-zero vectors only
    keys/v=<n>/_prefix=<p>/    id, _h: the key hashes again, by their leading bits
    _versions/<n>.json         {"version", "high_water", "batch", "dim", "records": [folders],
                                "vectors": [folders], "keys": [folders], "ranges", "reports"}

Records are range-partitioned and sorted by id and lie in folders of ``BLOCK_IDS`` ids, key
hashes in folders of ``2**PREFIX_BITS`` hash prefixes: a join on (block, id) or (prefix, hash)
prunes the folders at run time (dynamic partition pruning), with one plan at every number of
ids or keys. ``reports`` holds the report of the import that made the version; ``ledger()``
reads them all as a table.

A version is the list of folder pairs (segments) named in its version file, each
with the id range it may hold. An import only appends: it writes the new rows
into one new segment, so its cost follows the size of the import, not of the
store. Changes keyed by id (update, delete, saved embeddings) rewrite only the
segments whose range holds a changed id; ``compact()`` rewrites everything into
one segment. The version file is created last, under a new name (temporary
file, then rename), and never overwritten: readers take the highest version, a
failed job leaves the previous version readable, and two writers cannot both
publish the same version. ``high_water`` is the largest id ever assigned, so ids are
never reused after a delete.

S3 key scan, S4 listing, S5 lookup, S7 create, E1 migration and E2 backfill.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidepool.functions.text import preview
from tidepool.functions.vector import decode, finite, nonzero
from tidepool.operators.dedup import key_hash, prefix_of
from tidepool.schema import MIGRATION_DEFAULTS, RECORD_SCHEMA, VECTOR_SCHEMA
from tidepool.session import hadoop_path as _hpath

MAX_FOLDERS = 64  # appended folders per table before an import compacts
BLOCK_IDS = 1 << 18
#: What a records folder holds.
STORED_SCHEMA = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in RECORD_SCHEMA.fields] + ["_key_hash long", "_pending boolean", "_block int"])
LEDGER_SCHEMA = "stream string, batch_id long, added long, duplicate long, invalid long, near_duplicate long"


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _hpath(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        reader = spark.sparkContext._jvm.java.io.BufferedReader(
            spark.sparkContext._jvm.java.io.InputStreamReader(stream, "UTF-8")
        )
        lines = []
        line = reader.readLine()
        while line is not None:
            lines.append(line)
            line = reader.readLine()
        return "\n".join(lines)
    finally:
        stream.close()


def _create_text(spark: SparkSession, path: str, text: str) -> None:
    """Write ``text`` to a new file: temporary name, then rename (atomic, no overwrite)."""
    fs, p = _hpath(spark, path)
    tmp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    if fs.exists(p) or not fs.rename(tmp, p):
        fs.delete(tmp, False)
        raise RuntimeError(f"version pointer {path} already exists (a concurrent writer?)")


def _latest(spark: SparkSession, folder: str) -> str | None:
    fs, p = _hpath(spark, folder)
    if not fs.exists(p):
        return None
    names = [st.getPath().getName() for st in fs.listStatus(p)]
    names = sorted(n for n in names if n.endswith(".json"))
    return f"{folder}/{names[-1]}" if names else None


def _batches(batch: dict | int | None) -> dict:
    """Last batch by stream; a bare number is that of the unnamed stream."""
    if batch is None or batch == -1:
        return {}
    return dict(batch) if isinstance(batch, dict) else {"": int(batch)}


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@dataclass
class Snapshot:
    version: int
    high_water: int
    batch: dict  # last published batch by stream
    dim: int
    records: list[str] = field(default_factory=list)
    vectors: list[str] = field(default_factory=list)
    ranges: list[list[int]] = field(default_factory=list)  # [lo, hi] ids per segment
    keys: list[str | None] = field(default_factory=list)  # None: a segment from before the key folders


def migrate(df: DataFrame) -> DataFrame:
    """Add each missing column of the target schema with its default, keep rows.

    An ``embedding`` kept as JSON text is decoded ('' is pending; bad text raises).
    """
    have = set(df.columns)
    if "embedding" in have and isinstance(df.schema["embedding"].dataType, StringType):
        df = df.withColumn("embedding", decode("embedding"))
    for name, default in MIGRATION_DEFAULTS.items():
        if name not in have:
            df = df.withColumn(name, F.expr(default))
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RECORD_SCHEMA.fields])


def missing_vectors(records: DataFrame, vectors: DataFrame) -> DataFrame:
    """Records that hold a non-zero embedding but have no vector row."""
    return (
        records.where(F.col("embedding").isNotNull() & nonzero("embedding"))
        .select("id", F.col("embedding").alias("v"))
        .join(vectors.select("id"), "id", "left_anti")
    )


def backfill_vectors(records: DataFrame, vectors: DataFrame) -> DataFrame:
    """Add the missing vector rows; existing vector rows are kept untouched."""
    return vectors.select("id", "v").unionByName(missing_vectors(records, vectors))


def listing(records: DataFrame) -> DataFrame:
    """Id with previews of instruction and output, in id order."""
    return records.select(
        "id",
        preview("instruction").alias("instruction_preview"),
        preview("output").alias("output_preview"),
    ).orderBy("id")


def block_of(id_col: str) -> F.Column:
    return F.floor(F.col(id_col) / F.lit(BLOCK_IDS)).cast("int")


def lookup(records: DataFrame, ids: DataFrame) -> DataFrame:
    """The records whose id is in ``ids`` (unknown ids give nothing).

    One plan at every number of ids: a semi join, which Spark broadcasts where it measures the
    ids small. On a store's own folders (a ``_block`` column) the blocks that hold no wanted
    id are not read.
    """
    wanted = ids.select(F.col("id").cast("long").alias("id")).distinct()
    if "_block" not in records.columns:
        return records.join(wanted, "id", "left_semi")
    wanted = wanted.select("id", block_of("id").alias("_block")).where(F.col("_block") >= 0)
    return records.join(wanted, ["_block", "id"], "left_semi").drop("_block")


class Store:
    """A versioned pair of tables (records, vectors) under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -- pointer -------------------------------------------------------
    def current(self) -> Snapshot | None:
        latest = _latest(self.spark, f"{self.root}/_versions")
        text = _read_text(self.spark, latest) if latest else None
        if text is None:
            return None
        d = json.loads(text)
        recs = list(d.get("records", []))
        ranges = d.get("ranges") or [[0, int(d["high_water"])] for _ in recs]
        return Snapshot(int(d["version"]), int(d["high_water"]), _batches(d.get("batch")), int(d["dim"]),
                        recs, list(d.get("vectors", [])), [list(map(int, r)) for r in ranges],
                        list(d.get("keys") or [None] * len(recs)))

    def exists(self) -> bool:
        return self.current() is not None

    def _point(self, snap: Snapshot, reports: list[dict] | None = None) -> Snapshot:
        _create_text(self.spark, f"{self.root}/_versions/{snap.version:020d}.json", json.dumps({
            "version": snap.version, "high_water": snap.high_water, "batch": snap.batch,
            "dim": snap.dim, "records": snap.records, "vectors": snap.vectors,
            "ranges": snap.ranges, "keys": snap.keys, "reports": reports or [],
        }))
        return snap

    def ledger(self) -> DataFrame:
        """A row for each reported import: stream (empty without one), batch_id, and the four counts of its report."""
        kept = self.spark.read.schema(f"reports array<struct<{LEDGER_SCHEMA}>>").option("multiLine", "true").json(f"{self.root}/_versions/*.json")
        return kept.select(F.inline("reports"))

    # -- read ----------------------------------------------------------
    def _paths(self, names: list[str]) -> list[str]:
        return [f"{self.root}/{n}" for n in names]

    def _read(self, names: list[str]) -> DataFrame:
        """Records folders written here, as one scan (one without rows has no files to tell a schema)."""
        return self.spark.read.schema(STORED_SCHEMA).option("basePath", f"{self.root}/records").parquet(*self._paths(names)).drop("v")

    def _legacy(self, name: str) -> DataFrame:
        """A records folder from before the key folders, with whatever columns it holds."""
        fs, p = _hpath(self.spark, f"{self.root}/{name}")
        if all(st.getPath().getName().startswith(("_", ".")) for st in fs.listStatus(p)):
            return self.spark.createDataFrame([], RECORD_SCHEMA)
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/{name}")

    def _segments(self) -> list[DataFrame]:
        """All records folders: those written here in one scan, then the older ones."""
        snap = self._require()
        new = [n for n, k in zip(snap.records, snap.keys, strict=True) if k]
        old = [n for n, k in zip(snap.records, snap.keys, strict=True) if not k]
        return ([self._read(new)] if new else []) + [self._legacy(n) for n in old]

    def records(self) -> DataFrame:
        return _all([migrate(seg) for seg in self._segments()])

    def lookup(self, ids: DataFrame) -> DataFrame:
        """S5 on the current version: only the blocks that hold a wanted id are read."""
        names = RECORD_SCHEMA.fieldNames()
        return _all([lookup(seg.select(*names, "_block") if "_block" in seg.columns else migrate(seg), ids) for seg in self._segments()])

    def key_index(self) -> DataFrame:
        """(id, _h, _prefix): the 64-bit key hash of every record, 16 bytes a row to read.

        Segments written here keep the hashes in folders by prefix; for a folder from
        before that (a legacy layout) they are read from the records or computed from the texts.
        """
        snap = self._require()
        keyed = [f"{self.root}/{k}" for k in snap.keys if k]
        reader = self.spark.read.schema("id long, _h long, _prefix int").option("basePath", f"{self.root}/keys")
        parts = [reader.parquet(*keyed).select("id", "_h", "_prefix")] if keyed else []
        for name, key in zip(snap.records, snap.keys, strict=True):
            if not key:
                seg = self._legacy(name)
                rows = seg.select("id", F.col("_key_hash").alias("_h")) if "_key_hash" in seg.columns else migrate(seg).select("id", key_hash().alias("_h"))
                parts.append(rows.withColumn("_prefix", prefix_of("_h")))
        return _all(parts)

    def pending(self) -> DataFrame:
        """(id, instruction, input) of the records without an embedding.

        Segments written here carry a ``_pending`` flag, so the scan filters on
        a boolean and never decodes the embedding arrays; a legacy folder
        tests the array itself.
        """
        parts = []
        for seg in self._segments():
            flag = F.col("_pending") if "_pending" in seg.columns else F.col("embedding").isNull()
            if "embedding" not in seg.columns:
                flag = F.lit(True)
            parts.append(seg.where(flag).select("id", "instruction", "input"))
        return _all(parts)

    def vectors(self) -> DataFrame:
        snap = self._require()
        return self.spark.read.schema(VECTOR_SCHEMA).parquet(*self._paths(snap.vectors))

    def _require(self) -> Snapshot:
        snap = self.current()
        if snap is None:
            raise FileNotFoundError(f"no store at {self.root}")
        return snap

    # -- write ---------------------------------------------------------
    def _write(self, records: DataFrame, vectors: DataFrame, version: int | str, dim: int) -> tuple[str, str, str]:
        """All tables in new folders: records, vectors, keys. A vector that is not finite or not of the store's dimension (if it has one) raises."""
        attempt = f"{version}-{uuid.uuid4().hex[:12]}"  # a losing writer never touches published files
        r_name, v_name, k_name = (f"{table}/v={attempt}" for table in ("records", "vectors", "keys"))
        # Clustered by id over files and sorted inside them: few blocks and row groups hold a wanted id.
        (migrate(records).withColumn("_key_hash", key_hash())
         .withColumn("_pending", F.col("embedding").isNull())
         .withColumn("_block", block_of("id"))
         .repartitionByRange("id").sortWithinPartitions("_block", "id")
         .write.mode("errorifexists").partitionBy("_block").parquet(f"{self.root}/{r_name}"))
        # The schema is given, as an empty segment has no files to tell it.
        written = self.spark.read.schema("id long, _key_hash long").parquet(f"{self.root}/{r_name}")
        (written.select("id", F.col("_key_hash").alias("_h")).withColumn("_prefix", prefix_of("_h"))
         .repartition("_prefix").sortWithinPartitions("_prefix", "_h")
         .write.mode("errorifexists").partitionBy("_prefix").parquet(f"{self.root}/{k_name}"))
        sound = finite("v") & (F.lit(not dim) | (F.size("v") == F.lit(dim)))
        checked = F.when(sound, F.col("v")).otherwise(
            F.raise_error(F.concat(F.lit(f"vector not finite or not of dimension {dim}: id "), F.col("id").cast("string"))))
        (vectors.select("id", checked.alias("v")).sortWithinPartitions("id")
         .write.mode("errorifexists").parquet(f"{self.root}/{v_name}"))
        return r_name, v_name, k_name

    def publish(self, records: DataFrame, vectors: DataFrame, high_water: int,
                batch: dict | int | None = None, dim: int | None = None) -> Snapshot:
        """Rewrite both tables as the next version, then move the pointer."""
        prev = self.current()
        version = (prev.version + 1) if prev else 0
        dim = int(dim if dim is not None else (prev.dim if prev else 0))
        r_name, v_name, k_name = self._write(records, vectors, version, dim)
        return self._point(Snapshot(
            version, int(high_water),
            {**(prev.batch if prev else {}), **_batches(batch)}, dim,
            [r_name], [v_name], [[0, int(high_water)]], [k_name],
        ))

    def append(self, new_records: DataFrame, new_vectors: DataFrame, high_water: int,
               batch: dict | int | None = None, report: dict | None = None) -> Snapshot:
        """Add rows with new ids as one more folder per table (an import), with its report for the ledger."""
        prev = self._require()
        if len(prev.records) >= MAX_FOLDERS:
            prev = self.compact()
        version = prev.version + 1
        r_name, v_name, k_name = self._write(new_records, new_vectors, version, prev.dim)
        return self._point(Snapshot(
            version, int(high_water), {**prev.batch, **_batches(batch)}, prev.dim,
            prev.records + [r_name], prev.vectors + [v_name],
            prev.ranges + [[prev.high_water + 1, int(high_water)]], prev.keys + [k_name],
        ), [{"stream": s, "batch_id": b, **report} for s, b in (_batches(batch) or {"": None}).items()] if report else None)

    def rewrite(self, ids: DataFrame,
                fn: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]],
                added: tuple[DataFrame, DataFrame, int] | None = None) -> Snapshot:
        """Apply ``fn(records, vectors) -> (records, vectors)`` to the segments
        whose id range holds one of ``ids``; the other segments are kept as they are.
        ``added`` (records, vectors, high water) is one more segment of the same version.

        One aggregate over ``ids`` yields one flag per segment (at most
        ``MAX_FOLDERS`` values), so no join with the segment table is needed.
        """
        snap = self._require()
        flags = ids.agg(*[
            F.max(F.when(F.col("id").between(lo, hi), F.lit(1)).otherwise(F.lit(0))).alias(f"s{i}")
            for i, (lo, hi) in enumerate(snap.ranges)
        ]).first()
        hit = [i for i in range(len(snap.ranges)) if flags is not None and flags[i]]
        if not hit and added is None:
            return snap
        version, high_water = snap.version + 1, snap.high_water
        recs, vecs, keys, ranges = list(snap.records), list(snap.vectors), list(snap.keys), [list(x) for x in snap.ranges]
        for i in hit:
            r = migrate(self._read([recs[i]]) if keys[i] else self._legacy(recs[i]))
            v = self.spark.read.schema(VECTOR_SCHEMA).parquet(f"{self.root}/{vecs[i]}")
            r2, v2 = fn(r, v)
            recs[i], vecs[i], keys[i] = self._write(r2, v2, f"{version}-{i}", snap.dim)
        if added is not None:
            new_records, new_vectors, high_water = added
            for column, name in zip((recs, vecs, keys), self._write(new_records, new_vectors, f"{version}-new", snap.dim), strict=True):
                column.append(name)
            ranges.append([snap.high_water + 1, int(high_water)])
        return self._point(Snapshot(version, int(high_water), snap.batch, snap.dim, recs, vecs, ranges, keys))

    def compact(self) -> Snapshot:
        """Rewrite the current version into one folder per table."""
        snap = self._require()
        return self.publish(self.records(), self.vectors(), snap.high_water, snap.batch, snap.dim)

    def create(self, dim: int) -> Snapshot:
        """Empty tables when the store is absent; a no-op otherwise."""
        snap = self.current()
        if snap is not None:
            return snap
        empty_r = self.spark.createDataFrame([], RECORD_SCHEMA)
        empty_v = self.spark.createDataFrame([], VECTOR_SCHEMA)
        return self.publish(empty_r, empty_v, high_water=0, batch=-1, dim=dim)
