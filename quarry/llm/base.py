"""What the operators of this sub-package share: tables, work folders, size checks.

Work folders are below ``spark.checkpoint.dir``, which driver and executors
share. A session without one may use a local folder only if it runs in one
process (``local[...]``, as in tests); on a cluster that is an error.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its checked size is at most this many bytes.
BROADCAST_BYTES = 64 << 20
#: Bytes of text that a kernel works on at a time. One longer text goes alone: a worker needs about 100 bytes for each of its bytes.
CHUNK_BYTES = 256 << 10
#: Bytes of a batch on its way to a Python worker, unless the session says otherwise.
BATCH_BYTES = 8 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _default_batch(spark: SparkSession) -> str | None:
    """The batch size of a session that nobody has set."""
    return None if spark.sparkContext.getConf().get(_BATCH_KEY) else "67108864b"


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once a session, and bound the batches that go to them."""
    if spark.conf.get(_BATCH_KEY, None) == _default_batch(spark):
        spark.conf.set(_BATCH_KEY, f"{BATCH_BYTES}b")
    root = Path(__file__).resolve().parents[2]
    sc = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(":") or getattr(sc, "_quarry_shipped", False):
        return
    out = Path(tempfile.mkdtemp()) / "quarry_package.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted((root / "quarry").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(out))
    sc._quarry_shipped = True


def work_dir(spark: SparkSession) -> str:
    """A fresh path below the shared checkpoint folder."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='quarry-')}"
        spark.sparkContext.setCheckpointDir(top)
    return f"{top}/quarry-{uuid.uuid4().hex}"


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished work now, not when the driver next collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame) -> DataFrame:
    """Write df below the shared folder and read it again: cuts the lineage."""
    tidy(df.sparkSession)
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete what :func:`materialize` has written, when nothing reads it any more."""
    path = getattr(df, "_quarry_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, bytes_: int | float | None) -> DataFrame:
    """df with a broadcast hint if its checked size is within the bound, else as it is (Spark then shuffles)."""
    return F.broadcast(df) if bytes_ is not None and bytes_ <= BROADCAST_BYTES else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library: freed memory goes back when it likes
    _trim = None


def trim() -> None:
    """Give freed memory back to the system: a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def pieces(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch whose texts hold about ``limit`` bytes: (slice, bytes, offsets)."""
    if not batch.num_rows:
        return
    data, off = utf8(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to
    trim()


def longs(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A column of integers without nulls, as int64."""
    return batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())
