"""Spanning forests of links inside groups that may be very large.

A caller has rows ``(name, key, ...)`` and a task-side function that finds the links of one group. Rows of a group meet in
one task; a group too large for that is cut into pieces that all get a copy of its first member, so a group of like rows
is connected after one step and has moved once. Members that are not connected with the first one by then meet all
pieces in a second step. No link is left out, and no step lists the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.operators.components import connected_components
from postmill.sources.scratch import materialise, small_batches

WINDOW_BYTES = 1 << 24  # rows a task gathers before it searches


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the places where groups begin, and the end; a group is a run of rows that agree in the
    first two columns."""
    held: list[pa.RecordBatch] = []
    size, most = 0, WINDOW_BYTES

    def starts(table: pa.Table) -> np.ndarray:
        columns = [table.column(i).to_numpy() for i in (0, 1)]
        change = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        return np.concatenate([[0], np.flatnonzero(change) + 1, [table.num_rows]])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= most:
            table = pa.Table.from_batches(held)
            start = starts(table)
            if len(start) > 2:
                yield table.slice(0, int(start[-2])), start[:-1]
                table = table.slice(int(start[-2]))
            held, size = table.to_batches(), table.nbytes
            most = max(WINDOW_BYTES, 2 * size)
    if held:
        table = pa.Table.from_batches(held)
        yield table, starts(table)


def link_members(rows: pa.Table, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of one group; ``near(one, others)`` gives those of ``others`` that ``one`` is linked with.

    In a second step rows have a ``label``, which tells what the first step has connected, and a ``side``; only members of
    different sides are compared.
    """
    if rows.column("label").null_count:
        label, side = np.arange(rows.num_rows), None
    else:
        label = rows.column("label").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        side = rows.column("side").to_numpy()
    left, right = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for one in range(rows.num_rows - 1):
        others = one + 1 + np.flatnonzero(label[one + 1 :] != label[one])
        if side is not None:
            others = others[side[others] != side[one]]
        if len(others):
            others = near(one, others)
        if len(others):
            _, first = np.unique(label[others], return_index=True)
            others = others[first]
            left.append(np.full(len(others), one))
            right.append(others)
            label[np.isin(label, label[others])] = label[one]
    return np.concatenate(left), np.concatenate(right)


def named_links(table: pa.Table, left: np.ndarray, right: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    names = table.column("name").combine_chunks()
    columns = [names.take(pa.array(left)), names.take(pa.array(right)), *map(pa.array, more.values())]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", *more])


def _searched(dealt: DataFrame, key: str, find, schema: str, name: str) -> DataFrame:
    tasks = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in dealt.columns if c not in (key, "piece")]
    met = dealt.repartition(tasks, key, "piece").sortWithinPartitions(key, "piece", "name").select(key, "piece", *rest)
    with small_batches(dealt.sparkSession):
        return materialise(met.mapInArrow(find, schema), name)


def spanning_links(rows: DataFrame, key: str, fill: Column, columns: list[str], find, more: str = "") -> DataFrame:
    """``(a, b)``, and what ``more`` names in the schema: links that span the components of every group.

    ``rows`` are ``(name, key, *columns)``, a name at most once per key; ``find`` maps batches of ``(key, piece, name,
    *columns, side, label)`` to links. ``fill`` is an aggregate over a group: how many pieces it fills. Runs jobs.
    """
    kind = rows.schema["name"].dataType.simpleString()
    schema = f"a {kind}, b {kind}" + (f", {more}" if more else "")
    counted = rows.groupBy(key).agg(F.count("*").alias("_n"), F.ceil(fill).cast("long").alias("_pieces"), F.min("name").alias("_first"))
    counted = materialise(counted.where("_n > 1").drop("_n"), "shared-groups")
    cut = rows.join(counted, key).withColumn("piece", F.pmod(F.xxhash64("name"), F.col("_pieces")))
    fresh = [F.lit(None).cast("int").alias("side"), F.lit(None).cast(kind).alias("label")]
    pieces, blocks = (F.sequence(F.lit(0).cast("long"), F.col(c) - 1) for c in ("_pieces", "_blocks"))
    dealt = cut.select(key, "piece", "name", *columns, *fresh)
    if counted.where("_pieces > 1").isEmpty():
        return _searched(dealt, key, find, schema, "links")
    copies = cut.where("_pieces > 1 AND name = _first").select(key, F.explode(pieces).alias("_to"), "piece", "name", *columns).where("piece <> _to")
    links = _searched(dealt.unionByName(copies.select(key, F.col("_to").alias("piece"), "name", *columns, *fresh)), key, find, schema, "links")
    components = connected_components(links).select(F.col("id").alias("name"), F.col("component").alias("label"))
    large = cut.where("_pieces > 1").join(components, "name", "left").withColumn("label", F.coalesce("label", "name"))
    large = materialise(large, "large-groups")
    tops = large.where("name = _first").select(key, F.col("label").alias("_top"))
    outside = materialise(large.join(tops, key).where("label <> _top").drop("_top"), "outside")
    if outside.isEmpty():
        return links
    numbers = materialise(outside.groupBy(key).agg(F.ceil(fill).cast("long").alias("_blocks")), "outside-blocks")
    block = F.pmod(F.xxhash64("name", F.lit(1)), F.col("_blocks"))
    ours = outside.join(numbers, key).select(
        key, F.explode(F.transform(pieces, lambda i: block * F.col("_pieces") + i)).alias("piece"), "name", *columns, F.lit(0).alias("side"), "label"
    )
    theirs = large.join(numbers, key).select(
        key, F.explode(F.transform(blocks, lambda i: i * F.col("_pieces") + F.col("piece"))).alias("piece"), "name", *columns, F.lit(1).alias("side"), "label"
    )
    return links.unionByName(_searched(ours.unionByName(theirs), key, find, schema, "outside-links"))
