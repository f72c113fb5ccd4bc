import hashlib
import math
import random

import numpy as np
import pytest

from postmill.llm import ptolemy


def brute(rows, clusters, rounds, width):
    """``[(id, cluster, distance, cluster_inertia, inertia, centroid)]`` by comparing all with all, in Python's integers."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:clusters]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))[::-1] for _, v in kept]

    for _ in range(rounds):
        found = assigned()
        for j in range(len(centroids)):
            own = [v for (_, v), (c, _) in zip(kept, found) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    found = assigned()
    per = [sum(d for c, d in found if c == j) for j in range(len(centroids))]
    return sorted(((i, c, d, per[c], sum(per), tuple(centroids[c])) for (i, _), (c, d) in zip(kept, found)), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cluster string, cached int, id int").repartition(3)


def got(spark, rows, clusters, rounds, width):
    out = ptolemy.cluster_vectors(frame(spark, rows), clusters, rounds, width=width).collect()
    return sorted(((r.id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in out), key=str)


@pytest.mark.parametrize("clusters,spread", [(5, 0.05), (12, 1.0)])
def test_equals_brute_force(spark, clusters, spread):
    rng = random.Random(clusters)
    means = [[rng.randint(-2, 2) / 2 for _ in range(4)] for _ in range(6)]
    rows = [(i, [m + rng.gauss(0, spread) for m in rng.choice(means)]) for i in range(300)]
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    assert got(spark, rows, clusters, 3, 4) == brute(rows, clusters, 3, 4)


def test_ties_repeats_and_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 3), 0.0]) for i in range(40)] + [(7, [1.0, 0.0])] * 3 + [(None, [5.0, 5.0]), (None, [5.0, 5.0])]
    rows += [(100, None), (101, []), (102, [1.0]), (103, [1.0, None]), (104, [nan, 1.0]), (105, [inf, 1.0]), (106, [0.0, -inf]), (107, [1.0] * 3)]
    assert got(spark, rows, 10, 5, 2) == brute(rows, 10, 5, 2)


def test_few_or_no_vectors(spark):
    assert got(spark, [(3, [0.5, -0.001]), (4, None)], 40, 5, 2) == brute([(3, [0.5, -0.001])], 40, 5, 2)
    assert got(spark, [(4, None)], 40, 5, 2) == []


def test_components_out_of_range_raise(spark):
    with pytest.raises(Exception, match="exceeds"):
        got(spark, [(1, [1e7, 0.0])], 2, 1, 2)


def test_bounds_never_pass_over_the_nearest():
    rng = np.random.default_rng(1)
    for scale in (1, 300, ptolemy.MOST):
        vectors = rng.integers(-scale, scale + 1, (400, 16))
        vectors[:200] = vectors[0] + rng.integers(-1, 2, (200, 16)) * (scale < ptolemy.MOST)
        pivots = ptolemy.Pivots.choose(vectors[:50], 6)
        for centroids in (vectors[::20], vectors[:40]):
            exact = np.stack([ptolemy.squared(vectors, c) for c in centroids], axis=1)
            assert (pivots.bounds(pivots.measure(vectors), pivots.measure(centroids)) <= exact).all()
            cluster, distance, _ = ptolemy.nearest(vectors, pivots.measure(vectors), centroids, pivots)
            assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()


def test_bounds_spare_comparisons_in_clustered_vectors():
    rng = np.random.default_rng(2)
    centroids = rng.integers(-1000, 1000, (40, 8))
    vectors = np.repeat(centroids, 50, axis=0) + rng.integers(-30, 31, (2000, 8))
    pivots = ptolemy.Pivots.choose(vectors[::9], 6)
    assert ptolemy.nearest(vectors, pivots.measure(vectors), centroids, pivots)[2] < 0.2 * 2000 * 40
