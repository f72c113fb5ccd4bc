"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.sources.scratch import materialise

__all__ = ["chunks_by_size", "materialise", "read_table", "salted_rank", "with_place"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_place(df: DataFrame, name: str) -> DataFrame:
    """Add ``name``: the number of a row from 0 in the order of files and of rows in them. ``df`` reads a written parquet
    table; another frame is written first. The driver sees one count per file."""
    try:
        files = df.groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.count("*").alias("n")).collect()
    except AnalysisException:
        return with_place(materialise(df, "placed-rows"), name)
    part = re.compile(r"part-(\d+)")
    starts, start = [], 0
    for row in sorted(files, key=lambda r: (int(found[1]) if (found := part.search(r._file.rsplit("/", 1)[-1])) else -1, r._file)):
        starts.append((row._file, start))
        start += row.n
    table = F.broadcast(df.sparkSession.createDataFrame(starts, "_file string, _before long"))
    marked = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return marked.join(table, "_file").select(*df.columns, (F.col("_before") + F.col("_row")).alias(name))


def salted_rank(df: DataFrame, keys: Sequence[str], salt: Column, order: Sequence[Column | str], rank: str, buckets: int) -> DataFrame:
    """Add ``rank``: a gapless number from 0 within ``keys``, in order of (salt, ``order``).

    ``salt`` is an integer below ``buckets`` that does not depend on the partitioning. A key with a third of all
    rows is numbered in ``buckets`` tasks; what meets in one place is one count per key and salt. ``df`` is read
    twice, so pass a written table. Rows that agree in ``order`` get different numbers in any order.
    """
    keys = list(keys)
    salted = df.withColumn("_salt", salt)
    counts = salted.groupBy(*keys, "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys, "_salt").orderBy(*order)
    ranked = salted.withColumn("_in", F.row_number().over(within) - 1)
    same = [ranked[k].eqNullSafe(starts[k]) for k in keys] + [ranked["_salt"] == starts["_salt"]]
    joined = ranked.join(starts, same)
    columns = [ranked[c] for c in df.columns]
    return joined.select(*columns, (F.col("_start") + F.col("_in")).cast("long").alias(rank))


def chunks_by_size(texts: Sequence[str], most: int) -> Iterator[tuple[int, int]]:
    """Runs ``[lo, hi)`` of ``texts`` with ``most`` characters in all, or of one longer text."""
    lo = size = 0
    for i, text in enumerate(texts):
        if i > lo and size + len(text) > most:
            yield lo, i
            lo, size = i, 0
        size += len(text)
    if lo < len(texts):
        yield lo, len(texts)
