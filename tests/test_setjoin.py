import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.operators import neardup, setjoin
from postmill.sources import scratch


def brute(texts, threshold):
    """Lowest member of every component of similar texts, of components with at least two."""
    sets = [set(t.split(" ")) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both / (len(sets[i]) + len(sets[j]) - both) >= threshold and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return {i: x for i, x in enumerate(label) if label.count(x) > 1}


def found(spark, texts, threshold):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    pairs = neardup.near_duplicate_pairs(df, "id", threshold=threshold).collect()
    sets = [set(t.split(" ")) for t in texts]
    for p in pairs:
        exact = len(sets[p.id] & sets[p.leader]) / len(sets[p.id] | sets[p.leader])
        assert p.leader < p.id and p.jaccard == exact >= threshold
    want = brute(texts, threshold)
    assert len(pairs) == len(want) - len(set(want.values())), "a spanning forest"
    parent = list(range(len(texts)))
    for p in sorted(pairs, key=lambda p: p.id):
        a, b = p.id, p.leader
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        parent[max(a, b)] = min(a, b)

    def root(i):
        return i if parent[i] == i else root(parent[i])

    return {i: root(i) for p in pairs for i in (p.id, p.leader)}, want


def drifting(seed, n, length, changes, bases=1, vocabulary=400):
    rng = random.Random(seed)
    heads = [[f"v{rng.randrange(vocabulary)}" for _ in range(length)] for _ in range(bases)]
    out = []
    for _ in range(n):
        words = list(rng.choice(heads))
        for _ in range(rng.randrange(changes + 1)):
            words[rng.randrange(length)] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("seed,n,length,changes,bases,threshold", [(1, 150, 100, 4, 1, 0.95), (2, 200, 30, 3, 8, 0.8), (3, 120, 12, 4, 3, 0.5), (4, 80, 6, 1, 2, 1.0)])
def test_equals_brute_force(spark, seed, n, length, changes, bases, threshold):
    got, want = found(spark, drifting(seed, n, length, changes, bases), threshold)
    assert got == want


def test_groups_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "BUCKET_ROWS", 8)
    monkeypatch.setattr(setjoin, "FAMILY_ROWS", 8)
    got, want = found(spark, drifting(5, 120, 60, 3, 3), 0.95)
    assert got == want


def test_short_and_odd_texts(spark):
    texts = ["", " ", "a", "a a", "a b", "b a", "  a", "a b c", "c b a d", "é è", "è é", "x" * 10_000]
    for threshold in (0.5, 0.7, 1.0):
        got, want = found(spark, texts, threshold)
        assert got == want


def test_a_dense_group_without_links_ends(spark):
    """Four of 100 tokens replaced at random: pairs share most of their tokens, hardly any is similar."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for i in range(400):
        words = list(base)
        for at in rng.sample(range(100), 4):
            words[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    got, want = found(spark, texts, 0.95)
    assert got == want


def test_bitmaps_never_differ_more_than_sets():
    rng = np.random.default_rng(1)
    for n in (1, 10, 300, 5000):
        both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        own = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
        for bits in (setjoin.BITS, setjoin.FINE_BITS):
            a, b = setjoin.bitmap(both, bits), setjoin.bitmap(np.append(both, own), bits)
            assert np.bitwise_count(a ^ b).sum() <= 40


@pytest.mark.parametrize("threshold", [0.3, 0.8, 0.95, 1.0])
def test_classes_and_prefixes_miss_no_pair(threshold):
    for n in range(1, 400):
        assert 1 <= setjoin.prefix_length(n, threshold) <= n
        for m in range(n, min(400, int(n / threshold) + 2)):
            if n / m >= threshold:
                assert setjoin.length_class(m, threshold) - setjoin.length_class(n, threshold) in (0, 1)


def test_thresholds_out_of_range(spark):
    with pytest.raises(ValueError):
        setjoin.similar_sets(spark.range(1).select(F.col("id").alias("name"), F.array("id").alias("hashes")), 0.0)


def test_python_gets_small_batches(spark, tmp_path, monkeypatch):
    """2,000 sets of 2,000 tokens in one partition, 32 MB, of which 50 are linked with another."""
    log, limit = f"{tmp_path}/sizes", spark.conf.get(scratch.ARROW_BYTES)
    owner = next(c for c in type(spark.range(1)).__mro__ if "mapInArrow" in vars(c))
    plain = owner.mapInArrow

    def watched(self, function, schema, *args, **kwargs):
        def run(batches):
            def each():
                for batch in batches:
                    with open(log, "a") as out:
                        out.write(f"{batch.nbytes}\n")
                    yield batch

            return function(each())

        return plain(self, run, schema, *args, **kwargs)

    monkeypatch.setattr(owner, "mapInArrow", watched)
    own = F.when(F.col("id") < 50, F.col("id") + 50).otherwise(F.col("id"))
    token = lambda i: F.xxhash64(F.when(i < 1, F.col("id")).otherwise(own), i)
    sets = spark.range(0, 2_000, 1, 1).select(F.col("id").alias("name"), F.transform(F.sequence(F.lit(0), F.lit(1_999)), token).alias("hashes"))
    links = setjoin.similar_sets(sets, 0.95).collect()
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in links} == {(i, i + 50) for i in range(50)}
    sizes = [int(x) for x in open(log)]
    assert sum(sizes) > 60_000_000 and max(sizes) < 1.2 * scratch.BATCH_BYTES
    assert spark.conf.get(scratch.ARROW_BYTES) == limit


def test_python_holds_few_copies(spark, tmp_path, monkeypatch):
    """400 sets of 10,000 tokens in one partition, 32 MB, all of which are linked with another: a task holds a batch and
    what it makes of it, no further copies, and nothing of those before."""
    log = f"{tmp_path}/peaks"
    owner = next(c for c in type(spark.range(1)).__mro__ if "mapInArrow" in vars(c))
    plain = owner.mapInArrow

    def watched(self, function, schema, *args, **kwargs):
        def run(batches):
            tracemalloc.start()
            yield from function(batches)
            with open(log, "a") as out:
                out.write(f"{tracemalloc.get_traced_memory()[1]}\n")
            tracemalloc.stop()

        return plain(self, run, schema, *args, **kwargs)

    monkeypatch.setattr(owner, "mapInArrow", watched)
    token = lambda i: F.xxhash64(F.when(i < 1, F.col("id")).otherwise(F.floor(F.col("id") / 2)), i)
    sets = spark.range(0, 400, 1, 1).select(F.col("id").alias("name"), F.transform(F.sequence(F.lit(0), F.lit(9_999)), token).alias("hashes"))
    links = setjoin.similar_sets(sets, 0.95).collect()
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in links} == {(i, i + 1) for i in range(0, 400, 2)}
    peaks = [int(x) for x in open(log)]
    assert len(peaks) >= 4 and max(peaks) < 5 * scratch.BATCH_BYTES
