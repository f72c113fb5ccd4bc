import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.llm import hard_negatives as hn


def brute(rows, every, positives=5, negatives=3, band=(50, 95)):
    kept = {(i, l, tuple(math.floor(256 * x) for x in v)) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a in kept:
        if a[0] % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], c[2])), c[0], c[1] == a[1]) for c in kept if c != a)
        for p in [s for s in scored if s[2]][:positives]:
            fit = [s for s in scored if not s[2] and band[0] * -p[0] <= 100 * -s[0] <= band[1] * -p[0]]
            out += [(a[0], p[1], rank, s[1], -p[0], -s[0]) for rank, s in enumerate(fit[:negatives], 1)]
    return sorted(out)


def got(spark, rows, every, kind="int", **options):
    df = spark.createDataFrame([(i, v, l, 1, 2, 3) for i, v, l in rows], f"vec_id long, embedding array<float>, label {kind}, row int, side int, low int").repartition(3)
    return sorted(tuple(r) for r in hn.mine_negatives(df, F.col("vec_id") % every == 0, **options).collect())


def vectors(n, width, spread, labels, seed):
    rng = random.Random(seed)
    means = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(labels)]
    return [(i, np.float32([m + rng.gauss(0, spread) for m in means[i % labels]]).tolist(), rng.choice([i % labels, 0])) for i in range(n)]


@pytest.mark.parametrize("n,width,spread,labels", [(300, 64, 0.3, 4), (200, 3, 0.5, 2), (120, 8, 30.0, 30)])
def test_equals_brute_force(spark, n, width, spread, labels, monkeypatch):
    rows = vectors(n, width, spread, labels, n)
    want = brute(rows, 10)
    assert want and got(spark, rows, 10) == want
    monkeypatch.setattr(hn, "ANCHORS", 7)
    monkeypatch.setattr(hn, "CANDIDATES", 50)
    monkeypatch.setattr(hn, "TILE", (3, 11))
    assert got(spark, rows, 10) == want


def test_ties_repeats_and_rows_that_take_no_part(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.5, 1.0]), 1.0], rng.choice([1, 2])) for i in range(60)]
    rows += rows[:20] + [(0, [0.7, 0.7], 2), (0, [0.7, 0.7], 1)]
    rows += [(10, None, 1), (20, [1.0, None], 1), (30, [float("nan"), 1.0], 2), (40, [float("inf"), 0.0], 1), (50, [1.0, 1.0], None), (None, [1.0, 1.0], 1)]
    rows += [(110, [], 1), (120, [1.0], 1), (121, [1.0, 2.0, 3.0], 2)]
    assert got(spark, rows, 10) == brute(rows, 10)


def test_negative_scores_and_lone_labels_have_no_band(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [-0.7, 0.0], 2), (10, [1.0, 0.0], 3), (11, [0.0, 0.0], 4), (20, [0.0, 0.0], 4)]
    assert got(spark, rows, 10) == brute(rows, 10)


def test_labels_may_be_strings(spark):
    rows = [(i, v, "abc"[l % 3]) for i, v, l in vectors(60, 4, 0.4, 3, 5)]
    assert got(spark, rows, 10, "string", positives=2, negatives=1, band=(10, 99)) == brute(rows, 10, 2, 1, (10, 99))


def test_empty_tables(spark):
    assert got(spark, [(1, None, 1)], 1) == []
    assert got(spark, [(1, [1.0], 1), (2, [1.0], 2)], 7) == []


@pytest.mark.parametrize("low,high,width", [(-160, 154, 64), (-1, 1, 3), (0, 9, 1), (-20_000, 30_000, 64)])
def test_packed_products(low, high, width):
    rng = np.random.default_rng(width)
    packing = hn.Packing(low, high, width)
    for n in (1, 2, 17, 100):
        a, c = rng.integers(low, high + 1, (9, width)), rng.integers(low, high + 1, (n, width))
        a[0], c[0] = low, high
        assert (packing.scores(a, packing.pack(c), c) == a @ c.T).all()


def test_products_out_of_range_raise():
    with pytest.raises(ArithmeticError):
        hn.Packing(-(1 << 27), 1 << 27, 64)
