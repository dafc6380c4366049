"""Robots files as tables of ``robots_id`` and binary ``content``."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that ``to_files`` deals files out to; with over 32 of them Spark lists them in tasks.
FOLDERS = 64


def from_files(spark: SparkSession, path: str, pattern: str = "*robots.txt", tasks: int | None = None) -> DataFrame:
    """A row for each file under ``path``, named by its path.

    Spark puts no more than a few dozen files into a task, however small they
    are; ``tasks`` is the most tasks to read them in.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    named = found.select(F.col("path").alias("robots_id"), "content")
    return named if tasks is None else named.coalesce(tasks)


def _located(spark: SparkSession, path: str):
    """A path's file system, the path, and its name where executors can open it themselves, else None."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    full = files.makeQualified(at).toUri()
    return files, at, full.getPath() if full.getScheme() == "file" else None


def to_files(texts: DataFrame, path: str) -> None:
    """A file for each row of ``robots_id``, a number, and ``text``, which may not be null; the number is in the file's path.

    In a folder that all machines mount, tasks open the files themselves:
    Spark's writer makes a folder and a checksum for each of them, and starts
    a process for their permissions.  Other stores are left to that writer.
    A text is ended by a line feed, as Spark's writer does.
    """
    files, at, local = _located(texts.sparkSession, path)
    files.mkdirs(at)
    # Rows are dealt out by the same hash, so that a task has one folder.
    rows = texts.select("robots_id", "text", F.pmod(F.hash("robots_id"), F.lit(FOLDERS)).alias("folder")).repartition(FOLDERS, "robots_id")
    if local is None:
        rows.write.mode("append").partitionBy("folder", "robots_id").option("lineSep", "\n").text(path)
        return

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A file appears whole: an attempt that is stopped leaves a name that begins with a dot.
        made, own = set(), f".{uuid4().hex}"
        for batch in batches:
            for number, text, folder in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                place = f"{local}/folder={folder}"
                if folder not in made:
                    os.makedirs(place, exist_ok=True)
                    made.add(folder)
                with open(f"{place}/{own}", "wb", buffering=0) as f:
                    f.write(text.encode() + b"\n")
                os.replace(f"{place}/{own}", f"{place}/robots_id={number}.robots.txt")
            yield batch.select([0])

    rows.mapInArrow(put, rows.select("robots_id").schema).write.format("noop").mode("overwrite").save()


def remove_files(spark: SparkSession, path: str) -> None:
    """Deletes what ``to_files`` wrote; where executors can, each folder in a task."""
    files, at, local = _located(spark, path)
    if local is not None:
        spark.sparkContext.parallelize(range(FOLDERS), FOLDERS).foreach(lambda k: shutil.rmtree(f"{local}/folder={k}", ignore_errors=True))
    files.delete(at, True)


def from_texts(spark: SparkSession, texts: dict[str, bytes]) -> DataFrame:
    """A row for each given file."""
    return spark.createDataFrame([(k, bytearray(v)) for k, v in texts.items()], "robots_id string, content binary")


def write_debug(frame: DataFrame, path: str) -> None:
    """A sink of JSON lines for any table of the library."""
    frame.write.mode("overwrite").json(path)
