"""Sinks: Markdown, index and image files, the overwrite guard, and settings (SNK1-SNK7).

The canonical output is a table. Files are written by the executors: to object stores and
HDFS through pyarrow's file systems, to paths only where all machines mount the same folder.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def guard(queue: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """SNK2: adds status, ok or exists, by whether `existing` (destination) has a row's destination.

    Of rows that go to one destination the first wins without overwriting, the last with it.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("destination")
    there = existing.select("destination").distinct().withColumn("_there", F.lit(True))
    out = queue.join(there, "destination", "left")
    wins = F.col("queue_pos") == (F.max("queue_pos") if overwrite else F.min("queue_pos")).over(w)
    ok = wins if overwrite else wins & F.col("_there").isNull()
    return out.withColumn("status", F.when(ok, "ok").otherwise("replaced" if overwrite else "exists")).drop("_there")


def index_path(destination: str):
    """SNK3: the sidecar's path."""
    return F.regexp_replace(F.col(destination), r"\.[^./]*\z", ".index.md")


def write_files(rows: DataFrame, path: str = "destination", content: str = "text", mounted: bool = False) -> DataFrame:
    """SNK1, SNK3-SNK6: write each row's content (string or binary) to its path, folders made as needed.

    Returns path, n_bytes, error. A file appears whole or not at all: it is written beside
    its place and moved there, so that a task that runs twice does no harm. On a cluster a
    path without a scheme, or with file:, is refused unless `mounted` says that all machines
    share it; so is a scheme that no file system is known for.
    """
    master = rows.sparkSession.sparkContext.master
    local = mounted or master == "local" or master.startswith("local[")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = []
            for p, c in zip(batch["path"], batch["content"], strict=True):
                try:
                    done.append((p, put(p, c, local), None))
                except (OSError, ValueError, ImportError) as e:
                    done.append((p, 0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(done, columns=["path", "n_bytes", "error"])

    return rows.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content")).mapInPandas(run, "path string, n_bytes long, error string")


def put(path: str, data: bytes | None, local: bool = True) -> int:
    """Write one file whole; its length."""
    data = data or b""
    scheme = path.partition(":")[0] if "://" in path or path.startswith("file:") else ""
    if scheme not in ("", "file"):
        from pyarrow import fs

        there, at = fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + path[len(scheme) :])
        there.create_dir(at.rpartition("/")[0], recursive=True)
        part = f"{at}.{uuid.uuid4().hex}.part"
        with there.open_output_stream(part) as f:
            f.write(data)
        there.move(part, at)
        return len(data)
    if not local:
        raise ValueError("a path of one machine; give mounted=True if all machines share it")
    path = path.removeprefix("file://").removeprefix("file:")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, path)
    return len(data)


def save_settings(path: str, settings: dict) -> bool:
    """SNK7: sorted JSON, written whole; False where that is not possible."""
    try:
        put(path, json.dumps(settings, indent=2, sort_keys=True, ensure_ascii=False).encode())
    except OSError:
        return False
    return True
