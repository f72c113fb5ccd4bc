"""Joins whose big side may hold one key in a third of its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000


def attach(
    big: DataFrame,
    small: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    big_rows: int | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Join ``small``, which has one row per key, onto ``big``.

    Keys with at least ``hot_rows`` rows are joined by broadcast, all others by Catalyst's choice. There are at
    most ``rows(big) / hot_rows`` hot keys, which bounds what is broadcast: a trillion rows give a million
    keys at most. ``big`` is read more than once, so pass a table that is cheap to read. ``big_rows`` is an
    upper bound of its rows, if known; below ``hot_rows`` no key can be hot and one plain join is enough.
    Rows with a NULL key count as unmatched.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be left or inner")
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    on = [on] if isinstance(on, str) else list(on)
    if big_rows is not None and big_rows < hot_rows:
        return big.join(small, on, how)
    counts = big.dropna(subset=on).groupBy(*on).agg(F.count("*").alias("_n"))
    hot = counts.where(F.col("_n") >= hot_rows).select(*on)
    cold_rows = big.join(F.broadcast(hot), on, "left_anti").join(small, on, how)
    hot_small = small.join(F.broadcast(hot), on, "left_semi")
    hot_rows_joined = big.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(hot_small), on, how)
    return cold_rows.unionByName(hot_rows_joined)
