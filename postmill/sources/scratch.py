"""Intermediate tables on storage every executor can reach.

A written parquet table cuts lineage like a checkpoint, survives the loss of executors, and unlike a
checkpoint it is columnar: later passes that need only ids do not read the texts, and Catalyst sees its size.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SCRATCH = "spark.postmill.scratch"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 1 << 23


def scratch_root(spark: SparkSession) -> str:
    """Folder of this application under ``spark.postmill.scratch`` or, where that is unset, ``spark.checkpoint.dir``.

    Either must name a folder that all executors share.
    """
    root = spark.conf.get(SCRATCH, None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError(f"set {SCRATCH} or spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/postmill-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a reader over the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside send rows to Python in Arrow batches of about ``BATCH_BYTES`` or fewer, whatever their number, so that
    a worker's memory does not follow the sizes of rows and partitions; a lower limit of the session stays."""
    before = spark.conf.get(ARROW_BYTES)
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) <= BATCH_BYTES:
        yield
        return
    spark.conf.set(ARROW_BYTES, f"{BATCH_BYTES}b")
    try:
        yield
    finally:
        spark.conf.set(ARROW_BYTES, before)


def hadoop_fs(spark: SparkSession, path: str):
    """The Hadoop file system and path object for ``path``."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def drop_scratch(spark: SparkSession) -> None:
    """Remove every scratch table of this application; call it when no frame built from them is in use."""
    fs, target = hadoop_fs(spark, scratch_root(spark))
    fs.delete(target, True)
