"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only on one machine (tests) a missing setting is made up for by a temporary folder; a cluster has to name one.
    The folder is removed when the JVM ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="foldline-")
    where = f"{base.rstrip('/')}/foldline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return where


def stored(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/table"
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path.getParent(), True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, modulus: int):
    """crc32 of the column's decimal text, modulo modulus; null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def broadcast_below(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """df, a stored table of ids, to be broadcast if it has at most so many rows; else it is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


class Memo(dict):
    """A function's values by argument; emptied when it has grown to a number of entries."""

    def __init__(self, function, limit: int = 400_000, longest: int = 64):
        super().__init__()
        self.function, self.limit, self.longest = function, limit, longest

    def __missing__(self, key):
        value = self.function(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def tidy() -> None:
    """Gives back to the system what a task has freed: a worker goes on to other tasks, and its size counts in the executor's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def pieces(batch, size: int = 500):
    """Parts of an Arrow batch with a bounded number of rows."""
    for at in range(0, len(batch), size):
        yield batch.slice(at, size)
