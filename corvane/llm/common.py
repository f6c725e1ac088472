"""What the operators of this subpackage share: tables, checkpoints, Arrow helpers."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. A local folder is made only in local mode, where one machine is all there is."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if shared is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="checkpoints-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared)
    return shared


def checkpointed(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Cut the lineage with files in the shared folder, ``tasks`` at most, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return (df.coalesce(tasks) if tasks else df).checkpoint(eager=True)


def tasks_for(spark: SparkSession, amount: int, share: int) -> int:
    """Tasks, and so files, of a step over this amount at ``share`` a task: two for each core at least. A file of a few rows costs as much as a full one, and on a local disk also a process of the executor that sets its rights."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-amount // share))


def text_or_empty(col: str = "text") -> F.Column:
    return F.coalesce(F.col(col), F.lit(""))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column without nulls, as numpy views."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at.astype(np.int64)


def in_parts(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Slices (lo, hi) of a string column that hold so many bytes at most, unless one text alone holds more."""
    at = buffers(column)[1]
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """A 2-D byte array as a binary column, one value a row."""
    n, width = rows.shape
    offsets = (np.arange(n + 1, dtype=np.int64) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])
