"""Helpers that the operators of this subpackage share: shared-folder tables and sizes."""

from __future__ import annotations

import functools
import math
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.functions.shared import shared_dir


def _folder(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there.

    The table survives the loss of any executor, and a branch that reads it twice does
    not run what made it twice. The folder goes when the session's JVM ends, or with discard.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, folder = _folder(spark, path)
    fs.deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table that cut made of df, once nothing reads it any more."""
    fs, folder = _folder(df.sparkSession, df._cut_path)
    fs.delete(folder, True)


BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python in batches of BATCH_ROWS, unless the session asks for other than Spark's default size.

    Both sides of the pipe hold whole batches, and rows here are whole documents.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


UNKNOWN = 1 << 50


def input_bytes(df: DataFrame) -> int:
    """About how many bytes df has; it only sets numbers of partitions and buckets, never what is computed.

    Catalyst's estimate, which for a table is the size of its files. Where Catalyst has none
    (rows from the driver, say) the columns are measured in one pass.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= UNKNOWN:
        width = F.lit(0).cast("long")
        for name, kind in df.dtypes:
            long = F.octet_length(name) if kind in ("string", "binary") else 8 * F.size(name) if kind.startswith("array") else F.lit(8)
            width = width + F.coalesce(long, F.lit(0))
        size = df.agg(F.sum(width)).first()[0] or 0
    return max(1, size)


ROW_BYTES = 850


def pieces(df: DataFrame, least: int) -> int:
    """How many pieces the input makes, of `least` bytes or more.

    Where every piece sends a row to every other, the rows number the square of the pieces.
    The size of a piece grows as the square root of the input, so that a row carries about
    ROW_BYTES or more at any size: 5 MB at 30 GB, 290 MB at 100 TB. A task's memory grows alike.
    """
    size = input_bytes(df)
    return -(-size // max(least, math.isqrt(ROW_BYTES * size)))


def _murmur(x: np.ndarray) -> np.ndarray:
    """Spark's hash of 32-bit integers (Murmur3 with seed 42), by which it deals rows to partitions."""
    turn = lambda v, r: v << np.uint32(r) | v >> np.uint32(32 - r)
    h = np.uint32(42) ^ turn(x.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = (turn(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)) ^ np.uint32(4)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return (h ^ h >> np.uint32(16)).view(np.int32)


@functools.lru_cache(maxsize=8)
def group_keys(n: int) -> np.ndarray:
    """n integers of which repartition(n, column) puts each in a partition of its own, number i in partition i.

    Groups with these keys share no task, so that the largest task holds one group whatever
    n is; under keys 0..n-1 some partitions would hold several groups and others none.
    """
    out, left, at = np.zeros(n, np.int32), n, 0
    found = np.zeros(n, bool)
    while left:
        keys = np.arange(at, at + 4 * n, dtype=np.int32)
        home, first = np.unique(np.mod(_murmur(keys), n), return_index=True)
        new = ~found[home]
        out[home[new]], found[home[new]] = keys[first[new]], True
        left, at = n - int(found.sum()), at + 4 * n
    return out
