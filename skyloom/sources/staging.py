"""Intermediate tables that outlive an executor: written to the shared folder, read back with a cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset (local sessions)."""
    conf = spark.sparkContext.getConf()
    told = conf.get("spark.checkpoint.dir") or _OWN.get(spark.sparkContext.applicationId)
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        told = _OWN[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="skyloom-")
    return told.rstrip("/")


_OWN: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, *_store(spark, path))  # both outlive the session
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, whole after a lost executor."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def wide_rows(spark: SparkSession, rows: int = 4) -> Iterator[None]:
    """Jobs that run within take so few rows of a table at a time, in the JVM and in Python: for tables whose rows hold a chunk of samples."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, rows)
        yield
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


def as_bytes(arrays: list[np.ndarray], dtype: type) -> pa.Array:
    """Numbers of a chunk as bytes, which Spark copies whole; a list's it copies one by one."""
    return pa.array([a.astype(dtype, copy=False).tobytes() for a in arrays], pa.binary())


def from_bytes(b: pa.RecordBatch, r: int, column: str, dtype: type) -> np.ndarray:
    """Read-only."""
    return np.frombuffer(b[column][r].as_buffer(), dtype)


def bucketed(df: DataFrame, keys: list[str], name: str = "table") -> DataFrame:
    """``df`` as a table whose files are dealt by ``keys``: joins and groupings by them move none of its rows, each time it is read."""
    spark = df.sparkSession
    path, table = shared_path(spark, name), f"skyloom_{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    atexit.register(_dropped, spark, table)
    return spark.table(table)


def _dropped(spark: SparkSession, table: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone, and with it a catalog in memory
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put(spark: SparkSession, path: str, blob: bytes) -> None:
    """One file in any store that Spark reaches, written by the driver, over what was there."""
    at, fs = _store(spark, path)
    fs.setWriteChecksum(False)
    out = fs.create(at, True)
    try:
        for k in range(0, len(blob), 1 << 22):
            out.write(bytearray(blob[k : k + (1 << 22)]))
    finally:
        out.close()


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a file if there is one; raises where that can't be done."""
    at, fs = _store(spark, path)
    if fs.exists(at) and not fs.delete(at, False):
        raise OSError(f"can't delete {path}")


def _delete(at, fs) -> None:
    with contextlib.suppress(Exception):  # the store or the JVM may be gone
        fs.delete(at, True)


def discard(spark: SparkSession, path: str) -> None:
    _delete(*_store(spark, path))


def discard_table(df: DataFrame) -> None:
    """Deletes what ``written`` made, once nothing reads it any more."""
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        discard(df.sparkSession, f)
