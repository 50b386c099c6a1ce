"""Shared helpers of the training-text operators: shared storage, column guards, Arrow loops."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word in every contract of this subpackage: a maximal run of non-blank characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir`` of the session.

    A folder of our own is set only where the session names none and driver and executors are one
    process (a local test session); on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage is cut, and every
    executor can read the rows even after the one that wrote them is lost."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the folders that a materialised table was read from, once nothing needs it."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner, which works in the background, drop the shuffle files of plans no longer referenced."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Rows of whole texts go to Python workers in Arrow batches of at most so many; a smaller setting of the session stays.

    A batch is held by the executor's JVM and by the worker at once, and the session's usual 10,000 rows are
    a whole split of texts.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, rows)


def every(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text column, empty for null."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def id_crc32(column: str = "doc_id") -> Column:
    """crc32 of the id written as text; null ids count as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def tidy(run):
    """A function of Arrow batches that hands freed memory back to the system at its end: workers
    live on from stage to stage, and what an allocator keeps for one is missing in the next."""

    @wraps(run)
    def tidied(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return tidied


def byte_rows(batches: Iterator[pa.RecordBatch], column: str = "text", chunk: int = 512):
    """(record batch, list of bytes) in slices of a few hundred rows, to bound memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, chunk):
            part = batch.slice(at, chunk)
            yield part, part.column(part.schema.get_field_index(column)).to_pylist()
