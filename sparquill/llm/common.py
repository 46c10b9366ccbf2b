"""Shared folder, written intermediate tables, and small helpers of the training-data operators."""
from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors reach: spark.checkpoint.dir of the session.

    Where a local session names none (tests, notebooks), one is set for this application; on a cluster
    that is an error, as executors would write what the driver can't read.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="sparquill-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def mounted(spark: SparkSession, path: str) -> str | None:
    """path as a file system path where it names a local or mounted folder, as Hadoop resolves it, else None."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if found.toUri().getScheme() is None:
        found = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(found)
    return found.toUri().getPath() if found.toUri().getScheme() == "file" else None


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and a lost executor costs nothing.

    The reader learns the table's real size from its files, so Catalyst can plan joins by it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete a table made by written() that no plan still reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, whatever its letters' case."""
    have = {c.lower() for c in df.columns}
    name = base
    while name.lower() in have:
        name += "_"
    return name


def col(name: str) -> F.Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work for mapInArrow that hands freed memory back at its end: workers live on, idle, beside later stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return run


#: Rows of whole texts in an Arrow batch: some MB, where Spark's default of 10,000 makes tens of MB on both sides.
BATCH_ROWS = 1024


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches limited to BATCH_ROWS rows: memory for texts stays small beside the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass
