"""Evaluate an expression once per row and use it many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    An outer expression named inside a lambda is evaluated again for every element; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add ``value`` as a column behind a generator of one element.

    A filter on a plain column is pushed down with a copy of the column's expression in it, and every further
    mention in the filter is another copy. Filters do not pass a generator's output.
    """
    return df.withColumn(name, F.explode_outer(F.array(value)))
