"""Readers and writers for post tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.sources.scratch import hadoop_fs

POSTS = T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.IntegerType())])
TWEETS = T.StructType([T.StructField("tweet", T.StringType()), T.StructField("sentiment", T.IntegerType())])

# Quotes inside a CSV value are doubled.
_CSV = {"quote": '"', "escape": '"'}


def read_posts(
    spark: SparkSession,
    path: str | Sequence[str],
    format: str = "parquet",
    schema: T.StructType | str | None = None,
    header: bool = True,
    multi_line: bool = True,
) -> DataFrame:
    """Read posts from parquet, CSV or JSON lines. CSV and JSON need a schema: inference is a second full read.

    CSV does not tell an empty text from a missing one; both are read as NULL. A CSV record may span lines. Without ``multi_line`` it may not, and Spark can split a large file.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    paths = [path] if isinstance(path, str) else list(path)
    if format == "parquet":
        return reader.parquet(*paths)
    if schema is None:
        raise ValueError(f"reading {format} needs a schema")
    if format == "csv":
        return reader.options(header=header, multiLine=multi_line, **_CSV).csv(paths)
    if format == "json":
        return reader.json(paths)
    raise ValueError(f"unknown format {format!r}")


def write_posts(
    df: DataFrame,
    path: str,
    format: str = "parquet",
    mode: str = "errorifexists",
    partition_by: Sequence[str] = (),
) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if format == "parquet":
        writer.parquet(path)
    elif format == "csv":
        writer.options(header=True, **_CSV).csv(path)
    elif format == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown format {format!r}")


def read_splits(spark: SparkSession, path: str, splits: str | Sequence[str] | None = None) -> DataFrame:
    """Read a table laid out as ``split=<name>/`` folders; naming splits prunes the other folders."""
    df = spark.read.parquet(path)
    if splits is None:
        return df
    return df.where(F.col("split").isin([splits] if isinstance(splits, str) else list(splits)))


def write_splits(df: DataFrame, path: str, split_col: str = "split", mode: str = "errorifexists") -> None:
    write_posts(df.withColumnRenamed(split_col, "split"), path, mode=mode, partition_by=["split"])


def convert_format(
    spark: SparkSession,
    source: str,
    target: str,
    schema: T.StructType | str,
    mode: str = "errorifexists",
    header: bool = True,
    multi_line: bool = True,
) -> DataFrame:
    """Turn a CSV of posts into a parquet table and return a reader over it.

    Without ``multi_line`` no record may span lines, and Spark can split a large file.
    """
    posts = read_posts(spark, source, format="csv", schema=schema, header=header, multi_line=multi_line)
    write_posts(posts, target, mode=mode)
    return spark.read.schema(schema).parquet(target)


def _rename(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"could not rename {source} to {target}")


def replace_table(df: DataFrame, path: str) -> str:
    """Replace the parquet table at ``path``; the previous version stays next to it as ``<path>_old``.

    The new version is complete before anything is renamed, so ``df`` may read the table it replaces. A version from
    an earlier replacement is removed only when the new one is in place; when a rename fails, the table and the earlier
    version are put back and the error is raised.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    tag = uuid.uuid4().hex
    fs, current = hadoop_fs(spark, path)
    _, kept = hadoop_fs(spark, f"{path}_old")
    _, fresh = hadoop_fs(spark, f"{path}_new_{tag}")
    _, aside = hadoop_fs(spark, f"{path}_older_{tag}")
    df.write.parquet(f"{path}_new_{tag}")
    undo = []
    try:
        if fs.exists(current):
            if fs.exists(kept):
                _rename(fs, kept, aside)
                undo.append((aside, kept))
            _rename(fs, current, kept)
            undo.append((kept, current))
        _rename(fs, fresh, current)
    except Exception:
        for moved, back in reversed(undo):
            _rename(fs, moved, back)
        fs.delete(fresh, True)
        raise
    fs.delete(aside, True)
    return f"{path}_old"


def split_accepted_rejected(df: DataFrame, accepted: Column) -> tuple[DataFrame, DataFrame]:
    """Two frames: rows for which ``accepted`` is true, and all others, NULL verdicts included."""
    verdict = F.coalesce(accepted, F.lit(False))
    return df.where(verdict), df.where(~verdict)


def write_accepted_rejected(df: DataFrame, accepted: Column, path: str, format: str = "parquet", mode: str = "errorifexists") -> tuple[DataFrame, DataFrame]:
    """Write both sides in one pass, as ``side=accepted`` and ``side=rejected`` folders (CSV with a header), and return
    a reader over each. ``df`` is evaluated once."""
    side = F.when(F.coalesce(accepted, F.lit(False)), "accepted").otherwise("rejected")
    write_posts(df.withColumn("side", side), path, format=format, mode=mode, partition_by=["side"])
    schema = T.StructType([*df.schema.fields, T.StructField("side", T.StringType())])
    reader = df.sparkSession.read.schema(schema)
    every = reader.options(header=True, multiLine=True, **_CSV).csv(path) if format == "csv" else reader.format(format).load(path)
    return tuple(every.where(F.col("side") == name).drop("side") for name in ("accepted", "rejected"))
