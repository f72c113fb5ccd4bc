"""Centroid clustering in whole numbers, with Ptolemaic lower bounds over pivots.

Ptolemy's inequality holds in Euclidean space: for a vector x, a centroid c and two pivots p and s,

    d(x, c) >= |d(x, p) d(c, s) - d(x, s) d(c, p)| / d(p, s).

The pivots are fixed, so every vector caches its distances to them once, and a round measures the centroids against
them on the driver. A vector is first compared with the centroid of the smallest bound; centroids whose bound lies above
that distance are passed over, all others are compared exactly, in whole numbers. Bounds are rounded down by more than
the error of their floating point steps, so no nearer centroid, and no equal one, is ever passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import materialise

SCALE = 256
MOST = (1 << 27) - 1  # components up to here keep every squared distance of 64 of them in a long
PIVOTS = 6
PIVOT_POOL = 256  # vectors the pivots are chosen from, a bounded sample
SLACK = 2.0**-48  # 32 units of rounding, several times what a bound can lose
CHECKED = 16_384  # pairs compared exactly at once


def whole_components(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of every component as int. Raises where one does not fit the arithmetic."""
    grown = F.transform(vector, lambda x: x.cast("double") * scale)
    large = F.exists(grown, lambda x: F.abs(x) > MOST)
    return F.when(large, F.raise_error(F.lit(f"a component times {scale} exceeds {MOST}")).cast("array<int>")).otherwise(
        F.transform(grown, lambda x: F.floor(x).cast("int"))
    )


def is_finite(vector: Column) -> Column:
    """Whether a vector is there and no component is NULL, NaN or infinite."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))


def squared(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to rows, or to one row."""
    apart = vectors - points
    return np.einsum("ij,ij->i", apart, apart)


@dataclass(frozen=True)
class Pivots:
    points: np.ndarray
    #: ``(first, second, distance)`` of the pairs that are apart.
    pairs: list[tuple[int, int, float]]

    @staticmethod
    def choose(pool: np.ndarray, count: int) -> Pivots:
        """Start with the first vector, then always take the one farthest from those taken."""
        chosen, nearest = [0], squared(pool, pool[0])
        while len(chosen) < min(count, len(pool)):
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, squared(pool, pool[chosen[-1]]))
        points = pool[chosen]
        between = np.sqrt(np.stack([squared(points, p) for p in points]).astype(np.float64))
        return Pivots(points, [(i, j, between[i, j]) for j in range(len(points)) for i in range(j) if between[i, j] > 0])

    def measure(self, vectors: np.ndarray) -> np.ndarray:
        """Exact squared distances to every pivot."""
        return np.stack([squared(vectors, p) for p in self.points], axis=1)

    def bounds(self, vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """Lower bounds of squared distances, from squared distances to the pivots."""
        x, c = np.sqrt(vectors.astype(np.float64)), np.sqrt(centroids.astype(np.float64))
        best = np.zeros((len(x), len(c)))
        for p, s, between in self.pairs:
            one, other = x[:, p, None] * c[None, :, s], x[:, s, None] * c[None, :, p]
            gap = np.abs(one - other) - SLACK * (one + other)
            np.maximum(best, gap * ((1 - SLACK) / between), out=best)
        return best * best * (1 - SLACK)


def nearest(vectors: np.ndarray, cached: np.ndarray, centroids: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of every vector, ties by the smaller number, its squared distance, and how many pairs were compared."""
    bounds = pivots.bounds(cached, pivots.measure(centroids))
    rows, first = np.arange(len(vectors)), bounds.argmin(axis=1)
    distance = np.full(bounds.shape, np.iinfo(np.int64).max)
    distance[rows, first] = reached = squared(vectors, centroids[first])
    open_ = bounds <= reached[:, None]
    open_[rows, first] = False
    row, column = np.nonzero(open_)
    for lo in range(0, len(row), CHECKED):
        r, c = row[lo : lo + CHECKED], column[lo : lo + CHECKED]
        distance[r, c] = squared(vectors[r], centroids[c])
    cluster = distance.argmin(axis=1)
    return cluster, distance[rows, cluster], len(rows) + len(row)


def _matrix(lists: pa.Array, width: int, kind: type = np.int64) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(lists), width)


def _assigned(table: DataFrame, centroids: np.ndarray, pivots: Pivots, id_col: str = "id") -> DataFrame:
    """``(id, cluster, distance)``."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, cached = _matrix(batch.column(1), centroids.shape[1]), _matrix(batch.column(2), len(pivots.points))
            cluster, distance, _ = nearest(vectors, cached, centroids, pivots)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    kind = table.schema[id_col].dataType.simpleString()
    return table.select(id_col, "vector", "cached").mapInArrow(assign, f"id {kind}, cluster int, distance long")


def _sums(table: DataFrame, centroids: np.ndarray, pivots: Pivots) -> dict[int, tuple[int, list[int]]]:
    """Rows and componentwise sums of every cluster that has rows; a task sends one row per cluster at most."""
    count, width = centroids.shape
    names = [f"s{i}" for i in range(width)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows = np.zeros((count, width), dtype=np.int64), np.zeros(count, dtype=np.int64)
        for batch in batches:
            vectors = _matrix(batch.column(0), width)
            cluster, _, _ = nearest(vectors, _matrix(batch.column(1), len(pivots.points)), centroids, pivots)
            rows += np.bincount(cluster, minlength=count)
            order = np.argsort(cluster, kind="stable")
            held, start = np.unique(cluster[order], return_index=True)
            if len(held):
                sums[held] += np.add.reduceat(vectors[order], start, axis=0)
        held = np.flatnonzero(rows)
        columns = [pa.array(held.astype(np.int32)), pa.array(rows[held]), *[pa.array(sums[held, i]) for i in range(width)]]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", *names])

    parts = table.select("vector", "cached").mapInArrow(add, ", ".join(["cluster int", "n long", *[f"{s} long" for s in names]]))
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names])
    return {row.cluster: (row.n, [row[s] for s in names]) for row in total.collect()}


def _with_cache(table: DataFrame, pivots: Pivots, width: int) -> DataFrame:
    def cache(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = len(pivots.points)
        for batch in batches:
            found = pivots.measure(_matrix(batch.column(1), width)).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(found) + 1, count, dtype=np.int32)), pa.array(found))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["id", "vector", "cached"])

    kind = table.schema["id"].dataType.simpleString()
    return table.select("id", "vector").mapInArrow(cache, f"id {kind}, vector array<int>, cached array<long>")


def _described(spark: SparkSession, assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``(cluster, cluster_inertia, inertia, centroid)``, one row per cluster that has rows."""
    inertia = {row.cluster: row.n for row in assigned.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    rows = [(c, n, sum(inertia.values()), centroids[c].tolist()) for c, n in inertia.items()]
    return spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")


def cluster_vectors(
    df: DataFrame, clusters: int, rounds: int, id_col: str = "vec_id", vector_col: str = "embedding", width: int = 64, seed: str = "2"
) -> DataFrame:
    """``(id, cluster, distance, cluster_inertia, inertia, centroid)`` of every vector that takes part.

    Vectors with exactly ``width`` components, none NULL, NaN or infinite, take part as whole numbers ``floor(256 x)``;
    others have no row. Centroids start as the vectors with the smallest SHA-256 of ``seed:id``, in that order; rows
    without an id come last, equal ids follow their components. Each round assigns all vectors to the nearest centroid,
    ties to the smaller number, and moves every centroid that has vectors to the floor of their mean. After the last
    round vectors are assigned once more. ``distance`` is squared, ``inertia`` its sum over all rows.

    Repeated rows and equal vectors are vectors like others. Fewer vectors than ``clusters`` give as many clusters. An
    empty table gives an empty result. Other columns are not read. A component whose 256-fold exceeds 2**27, or an
    inertia beyond a long, raises an error. Runs jobs; the driver holds centroids, 6 pivots and 256 vectors they are
    chosen from, and a round moves one row of sums per task and cluster. Vectors never move.
    """
    spark = df.sparkSession
    chosen = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where((F.size("vector") == width) & is_finite(F.col("vector")))
    whole = materialise(chosen.select("id", whole_components(F.col("vector")).alias("vector")), "whole-vectors")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = whole.orderBy(name.asc_nulls_last(), "vector").select("vector").limit(max(clusters, PIVOT_POOL)).collect()
    if not first:
        return whole.select("id", *[F.lit(0).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"))], F.col("vector").cast("array<long>").alias("centroid"))
    pool = np.array([row.vector for row in first], dtype=np.int64)
    centroids, pivots = pool[:clusters].copy(), Pivots.choose(pool[:PIVOT_POOL], PIVOTS)
    table = materialise(_with_cache(whole, pivots, width), "pivot-distances")
    for _ in range(rounds):
        for cluster, (count, total) in _sums(table, centroids, pivots).items():
            centroids[cluster] = [x // count for x in total]
    assigned = materialise(_assigned(table, centroids, pivots), "assigned")
    described = _described(spark, assigned, centroids)
    return assigned.join(F.broadcast(described), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
