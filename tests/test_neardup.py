import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.operators import components, minhash, neardup, skew


def corpus(spark):
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(4000)}" for _ in range(120)) for _ in range(12)]
    texts = []
    for i, text in enumerate(base):
        texts.append(text)
        if i % 2 == 0:
            texts += [text, text + " tail", text + f" more {i}"]
    texts += ["short", "short", "", "a b"]
    rng.shuffle(texts)
    return texts, spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)


def band_sets(texts):
    count, rows = minhash.best_bands()
    a, b = (x.tolist() for x in minhash.permutations(128))
    out = []
    for text in texts:
        hashes = [int.from_bytes(hashlib.sha1(t.encode()).digest()[:4], "little") for t in text.split(" ")]
        sig = [min(((x * h + y) % 2**64) % (2**61 - 1) & 0xFFFFFFFF for h in hashes) for x, y in zip(a, b)]
        out.append([tuple(sig[i * rows : (i + 1) * rows]) for i in range(count)])
    return out


def collide(x, y):
    return any(p == q for p, q in zip(x, y))


def brute_components(n, edges):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in edges:
        a, b = sorted((find(i), find(j)))
        parent[b] = a
    touched = {i for e in edges for i in e}
    return {i: find(i) for i in touched}


def test_signature_spans_do_not_matter(monkeypatch):
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 2**32, 1000, dtype=np.uint64)
    starts = np.array([0, 1, 400, 401, 990, 1000])
    whole = minhash.minima(hashes, starts, 16)
    monkeypatch.setattr(minhash, "_SPAN", 7)
    monkeypatch.setattr(minhash, "_BLOCK", 3)
    assert (minhash.minima(hashes, starts, 16) == whole).all()


def test_band_choice():
    bands, rows = minhash.best_bands(0.95, 128)
    assert (bands, rows) == (3, 42)
    assert minhash.best_bands(0.5, 128)[0] > bands


def test_signatures(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, None), (3, "b a")], "id long, text string")
    got = {r.id: r.signature for r in minhash.minhash_signature(df).collect()}
    assert got[2] is None and got[1] == got[3] and len(got[1]) == 128


def test_groups_equal_brute_force(spark):
    texts, df = corpus(spark)
    bands = band_sets(texts)
    edges = [(i, j) for i, j in combinations(range(len(texts)), 2) if collide(bands[i], bands[j])]
    want = brute_components(len(texts), edges)
    got = {r.id: r.group_id for r in neardup.near_duplicate_groups(df, "id").collect()}
    assert got == want and want
    kept = {r.id for r in neardup.remove_near_duplicates(df, "id").collect()}
    assert kept == {i for i in range(len(texts)) if want.get(i, i) == i}


def test_star_groups_equal_the_upward_walk(spark):
    texts, df = corpus(spark)
    bands = band_sets(texts)
    done, want = set(), set()
    for i in range(len(texts)):
        near = [j for j in range(len(texts)) if collide(bands[i], bands[j])]
        if i in done or len(near) < 2:
            continue
        done.update(near)
        want |= {(j, i) for j in near}
    got = {(r.id, r.group_id) for r in neardup.near_duplicate_groups(df, "id", grouping="star").collect()}
    assert got == want


def test_star_groups_by_hash_equal_the_walk(spark):
    texts, df = corpus(spark)
    bands = band_sets(texts)
    first = {t: i for i, t in reversed(list(enumerate(texts)))}
    done, walked = set(), set()
    for i in sorted(first.values(), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
        near = [j for j in first.values() if collide(bands[i], bands[j])]
        if i not in done and len(near) > 1:
            done.update(near)
            walked |= {(j, i) for j in near}
    walked |= {(i, i) for t, i in first.items() if texts.count(t) > 1 and i not in done}
    want = {(j, g) for i, g in walked for j in range(len(texts)) if first[texts[j]] == i}
    got = {(r.id, r.group_id) for r in neardup.near_duplicate_groups(df, "id", grouping="star", order="hash").collect()}
    assert got == want
    with pytest.raises(ValueError):
        neardup.near_duplicate_groups(df, "id", grouping="star", order="size")


def test_a_long_chain_takes_few_rounds_by_hash(spark, monkeypatch):
    tables, write = [], neardup.materialise
    monkeypatch.setattr(neardup, "materialise", lambda df, name: tables.append(name) or write(df, name))
    chain = spark.range(10_000).select("id", F.explode(F.array("id", F.col("id") + 1)).alias("key"))
    groups = neardup._star_groups(chain, "hash")
    assert tables.count("first-open") <= 30
    assert groups.select("id").distinct().count() == 10_000
    gaps = [r.group_id for r in groups.select("group_id").distinct().orderBy("group_id").collect()]
    assert all(2 <= b - a <= 3 for a, b in zip(gaps, gaps[1:])), "no two centres collide, and no text is left out"


def test_pairs_are_verified(spark):
    texts, df = corpus(spark)
    pairs = neardup.near_duplicate_pairs(df, "id", bands=16, rows=8).collect()
    sets = [set(t.split(" ")) for t in texts]
    assert pairs
    for p in pairs:
        assert p.leader < p.id
        a, b = sets[p.id], sets[p.leader]
        assert abs(p.jaccard - len(a & b) / len(a | b)) < 1e-12 and p.jaccard >= 0.95


@pytest.mark.parametrize("shared, similar", [(20, True), (18, False)])
def test_threshold(spark, shared, similar):
    text = " ".join(f"t{i}" for i in range(shared))
    df = spark.createDataFrame([(1, text), (2, text + " extra")], "id long, text string")
    assert (neardup.near_duplicate_pairs(df, "id", bands=128, rows=1).count() == 1) == similar


@pytest.mark.parametrize("salts", [1, 4_096, 2])
def test_a_bucket_of_most_texts(spark, monkeypatch, salts):
    monkeypatch.setattr(neardup, "SALTS", salts)
    df = spark.range(60).withColumn("text", F.when(F.col("id") % 3 == 0, "same words here").otherwise(F.concat(F.lit("other "), "id")))
    pairs = {(r.id, r.leader) for r in neardup.near_duplicate_pairs(df, "id").collect()}
    assert pairs == {(i, 0) for i in range(3, 60, 3)}
    groups = {r.id: r.group_id for r in neardup.near_duplicate_groups(df, "id").collect()}
    assert groups == {i: 0 for i in range(0, 60, 3)}


def test_overlap(spark):
    base = spark.createDataFrame([(1, "x y z"), (2, "p q r")], "id long, text string")
    candidate = spark.createDataFrame([(1, "x y z"), (5, "new one here"), (6, "new one here"), (7, "alone in this"), (8, None)], "id long, text string")
    assert {r.id for r in neardup.remove_overlap(candidate, base, "id").collect()} == {5, 6, 7, 8}
    assert {r.id for r in neardup.remove_overlap(candidate, base, "id", drop_internal=True).collect()} == {7, 8}


def test_no_duplicates(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c d")], "id long, text string")
    assert neardup.near_duplicate_groups(df, "id").count() == 0
    assert neardup.near_duplicate_groups(df, "id", grouping="star").count() == 0
    assert neardup.remove_near_duplicates(df, "id").count() == 2


def test_report(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "id long, text string")
    rows = neardup.group_report(neardup.near_duplicate_groups(df, "id"), df, "id").collect()
    assert sorted((r.group_id, r.id, r.text) for r in rows) == [(1, 1, "a b"), (1, 2, "a b")]


def shapes():
    rng = random.Random(1)
    return {
        "path": [(i, i + 1) for i in range(60)],
        "star": [(0, i) for i in range(1, 40)],
        "high centre": [(99, i) for i in range(40)],
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(70)],
        "shuffled path": [(a, b) for order in [rng.sample(range(70), 70)] for a, b in zip(order, order[1:])],
        "loops only": [(3, 3)],
    }


@pytest.mark.parametrize("shape", shapes())
def test_components(spark, monkeypatch, shape):
    monkeypatch.setattr(skew, "HOT_ROWS", 3)
    edges = shapes()[shape]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component for r in components.connected_components(df).collect()}
    assert got == brute_components(100, [e for e in edges if e[0] != e[1]])


@pytest.mark.parametrize("hot_rows", [1, 5, 1_000])
def test_attach_is_a_plain_join(spark, hot_rows):
    big = spark.createDataFrame([(i, 7 if i < 20 else i if i < 30 else None) for i in range(35)], "n int, k int")
    small = spark.createDataFrame([(7, "hot"), (25, "cold"), (99, "none")], "k int, v string")
    for how in ("left", "inner"):
        got = sorted(skew.attach(big, small, "k", how, hot_rows=hot_rows).select("n", "k", "v").collect(), key=str)
        assert got == sorted(big.join(small, "k", how).select("n", "k", "v").collect(), key=str)


def test_fixed_values_of_the_signature_scheme():
    a, b = minhash.permutations(128)
    assert (int(a[0]), int(b[0]), int(a[-1]), int(b[-1])) == FIRST_AND_LAST
    assert minhash.best_bands(0.95, 128) == (3, 42)


# Multiplier and offset of the first and the last permutation.
FIRST_AND_LAST = (775169054918279404, 1758426461858698312, 1931671111240692334, 1454448473341514576)


def test_a_leader_that_is_not_similar_does_not_hide_links(spark):
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(words[:60] + [f"x{i}" for i in range(30)]), " ".join(words), " ".join(words[:-1] + ["other"])]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    pairs = neardup.near_duplicate_pairs(df, "id", bands=32, rows=1).collect()
    assert [(r.id, r.leader) for r in pairs] == [(2, 1)]
    groups = neardup.near_duplicate_groups(df, "id", bands=32, rows=1, verify=True)
    assert sorted(tuple(r) for r in groups.collect()) == [(1, 1), (2, 1)]


def test_many_bands(spark):
    _, df = corpus(spark)
    assert minhash.band_keys(df, "id", 300, 1, num_perm=300).count() == 300 * df.count()


def test_copies_are_signed_once(spark):
    df = spark.createDataFrame([(i, f"text number {i % 4}") for i in range(20)], "id long, text string")
    signed = neardup.sign_corpus(df, "id")
    assert signed.bands.select("id").distinct().count() == 4 and signed.copies.count() == 16
    assert sorted(tuple(r) for r in neardup.near_duplicate_groups(df, "id").collect()) == [(i, i % 4) for i in range(20)]


def test_signing_keeps_the_splits(spark, tmp_path):
    spark.range(4000).selectExpr("id", "concat('some text ', id) AS text").coalesce(1).write.option("parquet.block.size", 4096).parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    before = df.rdd.getNumPartitions()
    assert minhash.minhash_signature(df).rdd.getNumPartitions() >= before


def test_verified_overlap(spark):
    words = [f"w{i}" for i in range(100)]
    base = spark.createDataFrame([(1, " ".join(words))], "id long, text string")
    near = " ".join(words[:-1] + ["z"])
    ours = spark.createDataFrame([(1, near), (2, "other words"), (3, "twin one"), (4, "twin one"), (5, None)], "id long, text string")
    assert sorted(r.id for r in neardup.remove_overlap(ours, base, "id", verify=True).collect()) == [2, 3, 4, 5]
    assert sorted(r.id for r in neardup.remove_overlap(ours, base, "id", verify=True, drop_internal=True).collect()) == [2, 5]
