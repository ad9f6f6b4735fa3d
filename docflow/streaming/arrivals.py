"""Files as they arrive: the queue as a stream (SRC1, F1, F2), and scan results joined to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docflow.operators.queue import destination, supported
from docflow.sources.files import Registry, convert

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """A stream of supported files below folder; each file once."""
    found = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(folder)
    return found.filter(supported("path"))


def convert_arrivals(spark: SparkSession, folder: str, out_root: str, registry: Registry | None = None) -> DataFrame:
    """destination, path, text, error, route of each file that arrives."""
    out = convert(arrivals(spark, folder), registry)
    return out.withColumn("destination", destination("path", F.lit(out_root)))


def run_available(stream: DataFrame, table: str, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Process all that has arrived and stop; what the checkpoint has seen is not processed again.

    Writes Parquet to `table`, or hands each micro-batch to `sink`.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(sink).start() if sink else writer.format("parquet").option("path", table).start()
    query.awaitTermination()
    return query
