import random

import pytest
from pyspark.sql import functions as F

from catalog import queries
from postmill.operators import neardup
from postmill.operators.band_index import BandIndex, text_name
from postmill.plans.curation import Curation, curate_synthetic


def texts(seed, n):
    rng = random.Random(seed)
    bases = [" ".join(f"w{rng.randrange(3000)}" for _ in range(150)) for _ in range(12)]
    return [rng.choice(bases) + rng.choice(["", "", " tail", f" more {i % 5}"]) if rng.random() < 0.6 else f"text of its own {rng.randrange(60)}" for i in range(n)]


def groups_at_once(df):
    groups = neardup.near_duplicate_groups(df, "id")
    return {r.id: r.group_id for r in groups.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_give_the_groups_of_one(spark, tmp_path, seed):
    rows = list(enumerate(texts(seed, 90)))
    df = spark.createDataFrame(rows, "id long, text string")
    index = BandIndex(spark, str(tmp_path / "index"))
    signed = [index.add(df.where(F.col("id") % 4 == b), b) for b in range(4)]
    assert sum(signed) == len({t for _, t in rows}), "every distinct text is signed once"
    assert index.add(df.where(F.col("id") % 4 == 3), 3) == signed[3], "a batch may be added again"
    assert index.add(df, 4) == 0
    named = df.select("id", text_name("text").alias("name")).join(index.groups(), "name").collect()
    lowest = {}
    for r in named:
        lowest[bytes(r.group)] = min(r.id, lowest.get(bytes(r.group), r.id))
    got = {r.id: lowest[bytes(r.group)] for r in named}
    want = groups_at_once(df)
    # Copies of one text alone are a group at once, but no collision.
    alone = {i for i, g in want.items() if len({rows[j][1] for j, h in want.items() if h == g}) == 1}
    assert got == {i: g for i, g in want.items() if i not in alone}
    with pytest.raises(ValueError):
        index.add(df, 2)


def test_unfinished_batches_do_not_count(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(list(enumerate(texts(3, 30))), "id long, text string")
    index = BandIndex(spark, str(tmp_path / "index"))
    index.add(df.where("id < 15"), 0)
    before = sorted(map(tuple, index.groups().collect()))
    monkeypatch.setattr(BandIndex, "_write", lambda self, out, part, batch: (_ for _ in ()).throw(OSError("lost")) if part == "merges" else BandIndex_write(self, out, part, batch))
    with pytest.raises(OSError):
        index.add(df, 1)
    monkeypatch.undo()
    assert index.batches() == [0] and sorted(map(tuple, index.groups().collect())) == before
    assert index.add(df, 1) == len({t for _, t in enumerate(texts(3, 30))}) - len(set(texts(3, 30)[:15]))


BandIndex_write = BandIndex._write


def test_empty_batches(spark, tmp_path):
    index = BandIndex(spark, str(tmp_path / "index"))
    none = spark.createDataFrame([(1, None)], "id long, text string")
    assert index.groups().collect() == [] and index.add(none, 0) == 0 and index.groups().collect() == []


def test_curation_in_batches_equals_curation_at_once(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    rows = [(i, t if rng.random() < 0.95 else None, rng.choice([0, 1, 2, None])) for i, t in enumerate(texts(4, 120))]
    rng.shuffle(rows)
    posts = spark.createDataFrame(rows, "id long, tweet string, sentiment int")
    human = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts(4, 120)[:8])], "id long, tweet string")
    want = sorted(tuple(r) for r in curate_synthetic(posts.limit(0), posts, human, "id").collect())
    kept = Curation(spark, str(tmp_path / "curation"), "id")
    signed = 0
    for batch in range(3):
        signed += kept.add_posts(posts.where(F.col("id") % 3 == batch), batch)
        kept.add_human(human.where(F.col("id") % 3 == batch), batch)
    assert sorted(tuple(r) for r in kept.result().collect()) == want and 0 < len(want) < 120
    assert signed == len({t for _, t, label in rows if t is not None and label is not None})


def test_the_query_joins_its_posts_once(spark, tmp_path, monkeypatch):
    n = 60
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("post number "), F.col("id") % 50).alias("text"), F.concat(F.lit("src"), F.col("id") % 20).alias("source"), F.lit("en").alias("lang"), F.lit(14).alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    seen, tweets = spark.sparkContext.accumulator(0), queries.src.tweets

    def read(text):
        seen.add(1)
        return text

    monkeypatch.setattr(queries.src, "tweets", lambda *a: tweets(*a).withColumn("tweet", F.udf(read, "string")("tweet")))
    kept = {r.doc_id for r in queries.curate_incremental(spark, str(tmp_path)).collect()}
    assert seen.value == n, "every post is made once, not once for each batch"
    monkeypatch.undo()
    assert kept == {r.doc_id for r in queries.curate_synthetic(spark, str(tmp_path)).collect()}
