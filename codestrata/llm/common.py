"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import functools
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tidy(run: Callable) -> Callable:
    """A task's function that gives freed memory back at its end: Python workers stay, and idle ones count too."""

    @functools.wraps(run)
    def wrapped(*args, **named):
        try:
            yield from run(*args, **named)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that no other column can clash."""
    return df.select(*(F.col(f"`{of}`").alias(name) for name, of in columns.items()))


def unused(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of the table has."""
    while name in df.columns:
        name += "_"
    return name


def texts(column: pa.Array) -> list[str]:
    """Python strings; null counts as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def slices(batch: pa.RecordBatch, name: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of up to about limit bytes in the named column, a row at least."""
    column = batch.column(name)
    sizes = np.diff(np.frombuffer(column.cast(pa.large_binary()).buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]) if len(column) else np.zeros(0)
    begin, total = 0, 0
    for end, size in enumerate(sizes.tolist(), 1):
        total += size
        if total >= limit:
            yield batch.slice(begin, end - begin)
            begin, total = end, 0
    if begin < len(column):
        yield batch.slice(begin)


#: Folders that this process has written.
_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder's name under spark.checkpoint.dir.

    Where that is unset a session on this machine alone gets a local folder; on a cluster it is an error, as executors
    don't share local folders.
    """
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
        base = "/tmp/checkpoints"
    _OWN.append(f"{base.rstrip('/')}/{uuid.uuid4().hex}")
    return _OWN[-1]


def clear(spark: SparkSession) -> None:
    """Deletes the tables that this process has written: for when no result that reads them is needed any more."""
    jvm = spark.sparkContext._jvm
    while _OWN:
        path = jvm.org.apache.hadoop.fs.Path(_OWN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """The same rows read back from a table in the shared folder: the lineage ends there."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
