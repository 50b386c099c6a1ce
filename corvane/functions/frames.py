"""Helpers of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables up to this size, as the optimizer estimates it, are dealt out anew.
SMALL = 256 << 20
#: Bytes of an Arrow batch of texts, about: some thousand texts, or some thousand vectors.
BATCH_BYTES = 2 << 20


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Rows go to Python workers in Arrow batches of at most about so many bytes; a smaller setting of the session stays, and this one stays for later queries.

    A worker holds a batch several times over (as it came, as Python's strings, as results), and the session's usual 64 MB or 10,000 rows
    are a whole split of texts, so that a worker would need the more the larger the splits are.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)))
    if now <= 0 or now > most:
        spark.conf.set(key, most)


def spread(df: DataFrame, most: int = SMALL) -> DataFrame:
    """A small table dealt evenly over all cores; a larger one as it is.

    A small Parquet file often is one row group, which a single task reads, however many splits it has. Dealing such a
    table out costs little beside the work on its texts; large tables have row groups enough and are not shuffled.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= most else df


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df over all cores by some columns, for work that is heavy beside its bytes: partitions of a given number are not merged for being small."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)
