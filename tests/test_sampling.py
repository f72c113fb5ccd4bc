import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postmill.operators import sampling, synonyms


def ids(spark, n, parts=3):
    return spark.range(0, n, 1, parts)


def ranked(n, seed):
    return sorted(range(n), key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())


@pytest.mark.parametrize("n, frac", [(0, 0.1), (1, 0.5), (10, 0.25), (25, 0.1), (400, 0.2), (7, 1.0), (7, 0.0)])
def test_split_takes_the_first_keys(spark, n, frac):
    out = sampling.train_val_split(ids(spark, n), frac, "id", seed=5).collect()
    chosen = {r.id for r in out if r.split == "validation"}
    assert len(out) == n
    assert chosen == set(ranked(n, 5)[: round(frac * n)])


def test_inexact_split_is_close(spark):
    n = sampling.train_val_split(ids(spark, 20_000), 0.1, "id", exact=False).where("split = 'validation'").count()
    assert 1_800 < n < 2_200


@pytest.mark.parametrize("n, k, sizes", [(11, 5, [3, 2, 2, 2, 2]), (3, 5, [1, 1, 1]), (200, 7, [29, 29, 29, 29, 28, 28, 28])])
def test_folds(spark, n, k, sizes):
    out = sampling.kfold(ids(spark, n), "id", k)
    counts = Counter(r.fold for r in out.collect())
    assert [counts[i] for i in sorted(counts)] == sizes
    train, validation = sampling.fold_sides(out, 0)
    assert train.count() + validation.count() == n


def test_choices_do_not_depend_on_partitioning(spark):
    a = sampling.train_val_split(ids(spark, 300, 1), 0.3, "id").collect()
    b = sampling.train_val_split(ids(spark, 300, 7).repartition(5), 0.3, "id").collect()
    assert sorted(a) == sorted(b)


def test_ranks_run_from_zero_in_every_class(spark, monkeypatch):
    df = ids(spark, 500).withColumn("label", F.when(F.col("id") < 30, 0).otherwise(1))
    out = sampling.rank_in_class(df, "id", "label", 9).collect()
    by_class = {c: [r.id for r in sorted(out, key=lambda r: r["rank"]) if r.label == c] for c in (0, 1)}
    order = ranked(500, 9)
    assert by_class == {0: [i for i in order if i < 30], 1: [i for i in order if i >= 30]}


def balanced_counts(rows):
    return Counter(r.label for r in rows)


@pytest.mark.parametrize("per_row, per_chunk", [(10_000, 100_000), (3, 7)])
def test_oversample(spark, monkeypatch, per_row, per_chunk):
    monkeypatch.setattr(sampling, "COPIES_PER_ROW", per_row)
    monkeypatch.setattr(sampling, "DRAWS_PER_TASK_ROW", per_chunk)
    rows = [(i, f"text {i}", 0 if i < 40 else 1 if i == 40 else 2) for i in range(43)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    out = sampling.oversample(df, "id").collect()
    assert balanced_counts(out) == {0: 40, 1: 40, 2: 40}
    assert {r.id for r in out if r.copy == 0} == set(range(43))
    assert len({(r.id, r.copy) for r in out}) == len(out)
    assert all(r.text == f"text {r.id}" for r in out)
    assert max(r.copy for r in out if r.id == 40) == 39


def test_pieces_do_not_change_the_result(spark, monkeypatch):
    rows = [(i, 0 if i < 60 else 1) for i in range(63)]
    df = spark.createDataFrame(rows, "id long, label int")
    plain = sorted(sampling.oversample(df, "id").collect())
    monkeypatch.setattr(sampling, "COPIES_PER_ROW", 4)
    monkeypatch.setattr(sampling, "DRAWS_PER_TASK_ROW", 5)
    assert sorted(sampling.oversample(df, "id").collect()) == plain


def test_rows_without_a_label_stay_as_they_are(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, None)], "id long, label int")
    out = sampling.oversample(df, "id").collect()
    assert balanced_counts(out) == {0: 2, 1: 2, None: 1}


def test_sample_per_class(spark):
    df = ids(spark, 50).withColumn("label", (F.col("id") % 2).cast("int"))
    out = sampling.sample_per_class(df, "id", n=4, requests=3).collect()
    groups = Counter((r.label, r.request) for r in out)
    assert set(groups.values()) == {4} and len(groups) == 6
    assert all(r.id % 2 == r.label for r in out)
    assert len({r.id for r in out}) == 24
    few = sampling.sample_per_class(df, "id", n=20, requests=3).collect()
    assert Counter((r.label, r.request) for r in few) == {(c, q): 20 for c in (0, 1) for q in range(3)}
    assert all(len({r.id for r in few if (r.label, r.request) == (1, q)}) == 20 for q in range(3))
    assert sampling.sample_per_class(df.where("id < 0"), "id").count() == 0


def test_synonym_copies(spark):
    rows = [(1, "up up and away", 0), (2, "no match here", 0), (3, "down and out", 1)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    table = spark.createDataFrame([("down", "lower"), ("and", "plus"), ("and", "with")], "token string, synonym string")
    out = synonyms.synonym_oversample(df, table, "id").collect()
    assert balanced_counts(out) == {0: 2, 1: 2}
    copy = [r for r in out if r.copy == 1]
    assert len(copy) == 1 and copy[0].id == 3
    changed = [(a, b) for a, b in zip("down and out".split(), copy[0].text.split()) if a != b]
    assert len(changed) == 1 and changed[0] in {("down", "lower"), ("and", "plus"), ("and", "with")}


def test_balance_modes(spark):
    df = spark.createDataFrame([(1, "a b", 0)], "id long, text string, label int")
    assert synonyms.balance(df, None, "id").first().copy == 0
    with pytest.raises(ValueError):
        synonyms.balance(df, "other", "id")
    with pytest.raises(ValueError):
        synonyms.balance(df, "synonym", "id")
