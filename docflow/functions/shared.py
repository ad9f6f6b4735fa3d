"""Tables in the folder that driver and executors share: they end a plan's lineage and outlive any executor."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where none is set and everything runs in one local process (tests), a
    temporary folder of this machine; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        path = os.path.join(tempfile.gettempdir(), "docflow-checkpoints")
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet and read it back. The folder goes when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


BATCH_ROWS = 200
UNKNOWN = 1 << 50


def small_batches(spark: SparkSession) -> None:
    """Send rows to Python in batches of at most BATCH_ROWS: both sides of the pipe hold whole batches, and a row may be a whole file."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def spread(df: DataFrame, piece: int, key: str) -> DataFrame:
    """df dealt by key to as many partitions as it has pieces of `piece` bytes, by Catalyst's estimate (the size of a
    table's files), so that a task's work and memory do not grow with the input. Where there is none, df as it is."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df if size >= UNKNOWN else df.repartition(max(1, -(-size // piece)), key)
