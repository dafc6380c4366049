"""What the operators share: reading tables, scratch space, column names."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlgate.sources.shared import shared_dir

#: Java regular expression of one run of the six ASCII blanks that end a word.
BLANKS = r"[\x20\x09-\x0D]+"


#: Bytes of rows that are sent to Python together.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to ``BATCH_BYTES`` at most, by which texts of any length take little memory at a time."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.conf.get(name).lower().rstrip("b")
    if not size.isdigit() or not 0 < int(size) <= BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def release() -> None:
    """Gives back to the system what is free in this process, but kept by its allocators."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``function`` for ``mapInArrow``, by a worker that gives memory back after it.

    Spark keeps idle workers, as many as a task had operators, for the tasks to
    come; without this each would stay as large as it ever was.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            release()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``, read by Spark so that any file system works."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, deleted by ``discard`` or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/crawlgate-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = _file_system(spark, path)
    files.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def discard(df: DataFrame) -> None:
    """Deletes the table that ``written`` returned, which nothing must read any more."""
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        files, at = _file_system(df.sparkSession, path)
        files.delete(at, True)


#: Characters of file names that are broadcast to number files; beyond it rows are numbered in a copy.
MOST_NAMES = 32_000_000


def placed(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the long column ``name``, a number that a row has whenever ``docs`` is read.

    Rows that come from Parquet files by projections and filters alone are
    numbered by their file and their place in it, which does not depend on how
    files are split among tasks.  All other rows are numbered in a copy in the
    shared folder, and the copy is returned.
    """
    plan = docs._jdf.queryExecution().analyzed()
    steady = plan.deterministic()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    if steady and plan.getClass().getSimpleName() == "LogicalRelation":
        p = prefixed([*docs.columns, name])
        path, row = p + "path", p + "row"
        try:
            source = docs.metadataColumn("_metadata")
            rows = docs.withColumns({path: source["file_path"], row: source["row_index"]})
        except AnalysisException:  # not Parquet files
            rows = None
        if rows is not None:
            names = sorted(r[0] for r in rows.select(path).distinct().collect())  # a row a file
            if sum(map(len, names)) <= MOST_NAMES and len(names) < 1 << 23:
                # From Arrow: rows of Python objects would be read by workers of another kind, which stay beside the others.
                files = docs.sparkSession.createDataFrame(pa.table({f"{p}file": pa.array(range(len(names)), pa.int64()), path: pa.array(names, pa.string())}))
                numbered = rows.join(F.broadcast(files), path).withColumn(name, F.shiftleft(p + "file", 40) + F.col(row))
                return numbered.drop(path, row, p + "file")
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "rows")


def bucket_of(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; null for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % n


def prefixed(names: list[str]) -> str:
    """A prefix that no name in ``names`` begins with, for working columns."""
    prefix = "w_"
    while any(x.lower().startswith(prefix) for x in names):
        prefix = "w" + prefix
    return prefix
