"""Row and column operators on post tables.

Spark rows have no order, so every operator that keeps "the first" row names an id column and keeps the
lowest id.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions import fixed, text as tx
from postmill.functions.labels import encode_labels

TWEET_NAMES = {"tweet": "text", "sentiment": "label"}
SENTENCE_NAMES = {"sentence": "text"}


def rename_columns(df: DataFrame, names: Mapping[str, str] = TWEET_NAMES) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def project_text_label(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``text`` and, if the table has one, ``label`` as int; ``keep`` names further columns such as the id."""
    columns = [*keep, "text"]
    if "label" in df.columns:
        return df.select(*columns, F.col("label").cast("int").alias("label"))
    return df.select(*columns)


def training_columns(df: DataFrame, mode: str) -> DataFrame:
    if mode not in fixed.TRAINING_COLUMNS:
        raise ValueError(f"unknown mode {mode!r}")
    return df.select(*fixed.TRAINING_COLUMNS[mode])


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that have a value in all ``columns``; spelled as null tests, which reach the scan (``dropna`` does not)."""
    for column in columns:
        df = df.where(F.col(column).isNotNull())
    return df


def min_words(df: DataFrame, n: int = 2, text_col: str = "text") -> DataFrame:
    return df.where(tx.has_words(text_col, n))


def of_class(df: DataFrame, label, label_col: str = "label") -> DataFrame:
    return df.where(F.col(label_col) == label)


def text_as_string(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Cast the text to string; NULL stays NULL and is not turned into a word."""
    return df.withColumn(text_col, F.col(text_col).cast("string"))


def drop_ids(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    return df.join(ids.select(id_col), id_col, "left_anti")


def keep_first(df: DataFrame, key_col: str, id_col: str) -> DataFrame:
    """The row with the lowest id for every value of ``key_col``.

    The hash in front of the key makes the sort compare eight bytes; the key itself still decides. Each map
    task first drops all but its own lowest row of a key, so a value held by a third of all rows reaches the
    reducer as one row per map task.
    """
    first = Window.partitionBy(F.xxhash64(key_col), F.col(key_col)).orderBy(id_col)
    return df.withColumn("_row", F.row_number().over(first)).where("_row = 1").drop("_row")


def head(df: DataFrame, n: int, id_col: str) -> DataFrame:
    return df.orderBy(id_col).limit(n)


def concat_splits(splits: Mapping[str, DataFrame]) -> DataFrame:
    """All splits in one table, with the name of its split on every row."""
    frames = [df.withColumn("split", F.lit(name)) for name, df in splits.items()]
    return _union(frames)


def combine_corpora(corpora: Mapping[str, DataFrame]) -> DataFrame:
    """All corpora in one table with a ``corpus`` column; rows are kept as they are, repeats included."""
    return _union([df.withColumn("corpus", F.lit(name)) for name, df in corpora.items()])


def merge_generated(main: DataFrame, generated: DataFrame, label_col: str = "sentiment", vocab: Mapping | None = None) -> DataFrame:
    """Append generated posts to the main table. Columns only one side has are NULL on the other.

    Class names are encoded; labels that are codes already are kept.
    """
    if generated.schema[label_col].dataType.typeName() == "string":
        code = encode_labels(label_col, dict(vocab or fixed.SENTIMENT_CODES))
        generated = generated.withColumn(label_col, code)
    generated = generated.withColumn(label_col, F.col(label_col).cast(main.schema[label_col].dataType))
    return main.unionByName(generated, allowMissingColumns=True)


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return merged


def drop_exact_rows(df: DataFrame, id_col: str | None = None) -> DataFrame:
    """Distinct rows; with ``id_col``, distinct on all other columns, under the lowest id of each set of copies."""
    if id_col is None:
        return df.dropDuplicates()
    others = [c for c in df.columns if c != id_col]
    return df.groupBy(*others).agg(F.min(id_col).alias(id_col)).select(*df.columns)


def clean_main(df: DataFrame, text_col: str = "tweet", label_col: str = "sentiment", id_col: str | None = None) -> DataFrame:
    """Distinct rows that have both a text and a label. The null filter runs first: it shrinks the shuffle."""
    return drop_exact_rows(drop_missing(df, [text_col, label_col]), id_col)
