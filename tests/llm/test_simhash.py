import random

import numpy as np
import pytest
import xxhash

from postmill.llm import simhash
from postmill.llm.common import materialise


def brute_fingerprint(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def components(codes, distance):
    """Lowest place reachable from each place."""
    near = np.bitwise_count(codes[:, None] ^ codes[None]) <= distance
    label = np.arange(len(codes))
    while True:
        lower = np.where(near, label[None], len(codes)).min(axis=1)
        if (lower == label).all():
            return label
        label = lower


@pytest.mark.parametrize("text", ["", None, " \t", "One", "a B\x0bc", "a b c d", "É é a b c d e", "x " * 9])
def test_fingerprint(text):
    assert simhash.fingerprint(text or "", 4) == brute_fingerprint(text, 4)


def gray_sorted(codes, group):
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    order = np.lexsort((rank, group))
    return codes[order], group[order]


@pytest.mark.parametrize("n,bases,groups", [(1, 1, 1), (400, 20, 1), (1500, 4, 3), (1200, 400, 30)])
def test_index_equals_brute_force(n, bases, groups):
    rng = np.random.default_rng(n)
    codes = rng.integers(0, 1 << 63, bases, dtype=np.uint64)[rng.integers(0, bases, n)]
    for _ in range(3):
        flip = np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
        codes = codes ^ np.where(rng.random(n) < 0.7, flip, np.uint64(0))
    codes = np.unique(codes)
    codes, group = gray_sorted(codes, np.sort(rng.integers(0, groups, len(codes))))
    index = simhash.GrayIndex(codes, group, 4)
    index.forest(step=64)
    for g in np.unique(group):
        own = np.flatnonzero(group == g)
        assert (index.label[own] == own[components(codes[own], 4)]).all()


def test_small_frontier_changes_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    codes = np.unique(np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 64, (500, 3)).astype(np.uint64)).sum(axis=1, dtype=np.uint64))
    codes, group = gray_sorted(codes, np.zeros(len(codes)))
    whole = simhash.GrayIndex(codes, group, 4)
    whole.forest()
    monkeypatch.setattr(simhash, "FRONTIER", 50)
    halved = simhash.GrayIndex(codes, group, 4)
    halved.forest()
    assert (whole.label == halved.label).all()


def test_masks_cover_every_link():
    for bands in (5, 6, 7):
        masks = simhash.table_masks(4, bands)
        rng = random.Random(bands)
        for _ in range(200):
            apart = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(apart & (m % (1 << 64)) == 0 for m in masks)


def texts(n=160):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 200]))] for _ in range(12)]
    out = ["", None, " ", "one"]
    while len(out) < n:
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block", [20_000, 7])
def test_groups_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    rows = [(1000 - i, t, "x") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string").repartition(5)
    got = {r.id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(df).collect()}
    ordered = sorted(rows)
    codes = np.array([brute_fingerprint(t, 4) for _, t, _ in ordered]).view(np.uint64)
    label = components(codes, 4)
    want = {ordered[i][0]: (int(codes[i].view(np.int64)), ordered[label[i]][0]) for i in range(len(ordered))}
    assert got == want


def test_repeats_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (5, None), (None, "z")], "doc_id long, text string")
    groups = materialise(simhash.simhash_groups(df), "groups")
    assert sorted((r.id or 0, r.component_id or 0) for r in groups.collect()) == [(0, 0), (0, 1), (1, 1), (1, 1), (5, 5)]
    kept = simhash.keep_one(df, groups).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept if r.doc_id) == [(1, "a b c d e"), (5, "")]
    assert simhash.simhash_groups(df.limit(0)).collect() == []


def test_one_row_of_each_component_is_kept(spark):
    rng = random.Random(9)
    a, b, c, d, e, f = [" ".join(f"v{rng.randrange(10_000)}" for _ in range(60)) for _ in range(6)]
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (7, d), (2, e), (9, e), (9, f), (None, e), (11, e), (12, None), (None, "")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang string").repartition(3)
    kept = simhash.keep_one(df, materialise(simhash.simhash_groups(df), "groups"))
    assert kept.columns == df.columns
    want = [(None, a), (None, b), (7, c), (7, d), (2, e), (9, f), (12, None)]
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, want))
    assert simhash.keep_one(df.limit(0), materialise(simhash.simhash_groups(df.limit(0)), "none")).collect() == []


def test_clashing_columns_are_kept(spark):
    names = "doc_id long, text string, _kept long, _own long, _code long, _n int, _row string, _id string, _text string, component_id long"
    extra = (1, 2, 3, 4, "r", "i", "t", 5)
    rows = [(1, "a b c d e", *extra), (2, "a b c d e", *extra), (3, "x y z", *extra), (3, "u v w p q r", *extra)]
    df = spark.createDataFrame(rows, names)
    kept = simhash.keep_one(df, materialise(simhash.simhash_groups(df), "groups"))
    assert kept.schema == df.schema and sorted(map(tuple, kept.collect())) == sorted([rows[0], *rows[2:]])
