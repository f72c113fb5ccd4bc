import json

import pytest
from pyspark.sql import functions as F

from postmill.operators import corpus, metrics
from postmill.plans import curation, preparation
from postmill.sources import files, scratch
from postmill.streaming import ingest


def posts(spark):
    rows = [(1, 'say "hi", all\nof you', 1), (2, "", 0), (3, None, 2), (4, "see http://x now", None)]
    return spark.createDataFrame(rows, "id long, text string, label int")


@pytest.mark.parametrize("format", ["parquet", "csv", "json"])
def test_round_trip(spark, tmp_path, format):
    df = posts(spark)
    files.write_posts(df, f"{tmp_path}/t", format)
    back = files.read_posts(spark, f"{tmp_path}/t", format, df.schema)
    if format == "csv":
        df = df.withColumn("text", F.nullif("text", F.lit("")))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_text_formats_need_a_schema(spark, tmp_path):
    with pytest.raises(ValueError):
        files.read_posts(spark, str(tmp_path), "csv")
    with pytest.raises(ValueError):
        files.write_posts(posts(spark), f"{tmp_path}/x", "xml")


def test_headerless_sample(spark, tmp_path):
    (tmp_path / "s.csv").write_text('\n$A up,1\n"B, \n""down""",-1\n', encoding="utf-8")
    rows = files.read_posts(spark, str(tmp_path / "s.csv"), "csv", files.POSTS, header=False).collect()
    assert [tuple(r) for r in rows] == [("$A up", 1), ('B, \n"down"', -1)]


def test_splits_are_pruned(spark, tmp_path):
    df = posts(spark).withColumn("split", F.when(F.col("id") < 3, "train").otherwise("test"))
    files.write_splits(df, f"{tmp_path}/s")
    train = files.read_splits(spark, f"{tmp_path}/s", "train")
    assert {r.id for r in train.collect()} == {1, 2}
    assert files.read_splits(spark, f"{tmp_path}/s").count() == 4
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_replace_keeps_the_old_version(spark, tmp_path):
    path = f"{tmp_path}/main"
    posts(spark).write.parquet(path)
    kept = files.replace_table(spark.read.parquet(path).where("id = 1"), path)
    assert spark.read.parquet(path).count() == 1 and spark.read.parquet(kept).count() == 4
    files.replace_table(posts(spark), path)
    assert spark.read.parquet(path).count() == 4 and spark.read.parquet(kept).count() == 1
    assert sorted(f.name for f in tmp_path.iterdir()) == ["main", "main_old"]


def test_a_failing_rename_leaves_both_versions(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/main"
    posts(spark).write.parquet(path)
    kept = files.replace_table(posts(spark).where("id = 1"), path)
    rename, calls = files._rename, []

    def failing(fs, source, target):
        calls.append(target)
        if len(calls) == 3:
            raise OSError("no")
        rename(fs, source, target)

    monkeypatch.setattr(files, "_rename", failing)
    with pytest.raises(OSError):
        files.replace_table(posts(spark).where("id < 0"), path)
    assert spark.read.parquet(path).count() == 1 and spark.read.parquet(kept).count() == 4
    assert sorted(f.name for f in tmp_path.iterdir()) == ["main", "main_old"]


def test_both_sides_are_written_once(spark, tmp_path):
    good, bad = files.write_accepted_rejected(posts(spark), F.col("id") == 1, f"{tmp_path}/sides", format="csv")
    assert good.count() == 1 and bad.count() == 3 and good.columns == posts(spark).columns


def test_csv_without_header(spark, tmp_path):
    (tmp_path / "plain.csv").write_text("\nfirst post,1\nsecond post,-1\n")
    out = files.convert_format(spark, f"{tmp_path}/plain.csv", f"{tmp_path}/plain", files.POSTS, header=False, multi_line=False)
    assert sorted((r.text, r.label) for r in out.collect()) == [("first post", 1), ("second post", -1)]


def test_scratch_follows_the_session(spark):
    setting = spark.conf.get("spark.checkpoint.dir", None)
    assert setting is None or scratch.scratch_root(spark).startswith(setting)


def test_normalise_keeps_the_lowest_id(spark):
    rows = [(2, "hi @bob there", 2), (1, "hi @amy there", 1), (3, "one", 0), (4, None, 1), (5, "a &amp; b", 0)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    out = preparation.normalise_corpus(df, "id").collect()
    assert sorted(map(tuple, out)) == [(1, "hi @USER there", 1), (5, "a & b", 0)]


def labelled(spark, n=60):
    text = F.concat(F.lit("post number "), F.col("id").cast("string"), F.lit(" of mine"))
    return spark.range(n).select("id", text.alias("tweet"), (F.col("id") % 7 % 3).cast("int").alias("sentiment"))


def test_training_set(spark):
    human = labelled(spark)
    synthetic = labelled(spark, 30).withColumn("tweet", F.concat("tweet", F.lit(" again")))
    balanced, validation = preparation.build_training_set(synthetic, human, "id")
    assert validation.count() == 12
    counts = {r.label: r.n_rows for r in metrics.class_counts(balanced).collect()}
    assert len(set(counts.values())) == 1
    assert balanced.where("copy = 0").count() == 30 + 48
    held_out = {r.id for r in validation.collect()}
    assert not {int(r.row_id[6:]) for r in balanced.where("corpus = 'human'").collect()} & held_out


def test_general_sentiment(spark):
    splits = {s: spark.createDataFrame([(i, f"{s} text", i)], "id long, text string, label int") for i, s in enumerate(["train", "test", "validation"])}
    out = preparation.prepare_general_sentiment(splits, "id", frac=0)
    assert {r.id: r.label for r in out.collect()} == {0: 2, 1: 0, 2: 1}


def test_merge_accepts_names_and_codes(spark):
    main = spark.createDataFrame([("a", 1, "x")], "tweet string, sentiment int, origin string")
    names = spark.createDataFrame([("b", "bearish"), ("c", "odd")], "tweet string, sentiment string")
    codes = spark.createDataFrame([("d", 2)], "tweet string, sentiment long")
    assert [tuple(r) for r in corpus.merge_generated(main, names).collect()] == [("a", 1, "x"), ("b", 2, None), ("c", None, None)]
    assert [tuple(r) for r in corpus.merge_generated(main, codes).collect()] == [("a", 1, "x"), ("d", 2, None)]


def test_curation(spark):
    main = spark.createDataFrame([(1, "a b c", 1), (2, "a b c", 1), (3, "human text", 0)], "id long, tweet string, sentiment int")
    new = spark.createDataFrame([(4, "a b c", "bearish"), (5, "fresh post", "neutral"), (6, "odd", "none")], "id long, tweet string, sentiment string")
    human = spark.createDataFrame([(1, "human text")], "id long, tweet string")
    out = curation.curate_synthetic(main, new, human, "id").collect()
    assert sorted((r.id, r.sentiment) for r in out) == [(1, 1), (5, 0)]


def body(*texts):
    answer = json.dumps({str(i): t for i, t in enumerate(texts)}) if texts else "sorry"
    return json.dumps({"output": {"choices": [{"text": answer}]}})


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"label": c, "body": b}) for c, b in rows))


def drain(spark, tmp, quota=500_000):
    ingest.ingest_responses(
        spark, f"{tmp}/landing", f"{tmp}/accepted", f"{tmp}/failed", f"{tmp}/state", quota=quota, available_now=True
    ).awaitTermination()
    good = sorted((r.label, r.tweet) for r in ingest.read_accepted(spark, f"{tmp}/accepted").collect())
    bad = sorted((r.label, r.reason) for r in ingest.read_failed(spark, f"{tmp}/failed").collect())
    return good, bad


def test_stream_quota_and_failures(spark, tmp_path):
    land(tmp_path / "landing", "1.json", [(0, body("a b c", "d e f")), (1, body()), (2, "broken")])
    assert drain(spark, tmp_path, quota=1) == ([(0, "a b c"), (0, "d e f")], [(1, "no_posts"), (2, "no_text")])
    land(tmp_path / "landing", "2.json", [(0, body("g h i")), (1, body("j k l"))])
    good, bad = drain(spark, tmp_path, quota=1)
    assert good == [(0, "a b c"), (0, "d e f"), (1, "j k l")]
    assert bad == [(0, "over_quota"), (1, "no_posts"), (2, "no_text")]


def test_a_hard_quota_is_met_exactly(spark, tmp_path):
    posts = [f"post number {i}" for i in range(50)]
    rows = [(0, body(*posts[:30])), (0, body(*posts[30:])), (1, body("a b c", "d e f")), (None, body("g h i", "j k l"))]
    landed = spark.createDataFrame(rows, ingest.RESPONSES).repartition(3)
    places = f"{tmp_path}/accepted", f"{tmp_path}/failed"

    def sides():
        good = sorted(((r.label, r.tweet) for r in ingest.read_accepted(spark, places[0]).collect()), key=str)
        bad = sorted(((r.label, r.generated, r.reason) for r in ingest.read_failed(spark, places[1]).collect()), key=str)
        return good, bad

    ingest.write_batch(landed, 0, *places, quota=20, hard_quota=True)
    good, bad = sides()
    kept = [t for c, t in good if c == 0]
    assert len(kept) == 20 and len([1 for c, _ in good if c != 0]) == 4
    assert sorted(kept + [t for c, t, reason in bad if (c, reason) == (0, "over_quota")]) == sorted(posts)
    ingest.write_batch(landed, 0, *places, quota=20, hard_quota=True)
    assert sides() == (good, bad)
    later = spark.createDataFrame([(0, body("one more post")), (1, body(*posts))], ingest.RESPONSES)
    ingest.write_batch(later, 1, *places, quota=20, hard_quota=True)
    counts = {r.label: r["count"] for r in ingest.read_accepted(spark, places[0]).groupBy("label").count().collect()}
    assert counts == {0: 20, 1: 20, None: 2}


def test_replayed_batch_changes_nothing(spark, tmp_path):
    land(tmp_path / "landing", "1.json", [(0, body("a b c"))])
    before = drain(spark, tmp_path)
    batch = spark.read.schema(ingest.RESPONSES).json(f"{tmp_path}/landing")
    ingest.write_batch(batch, 0, f"{tmp_path}/accepted", f"{tmp_path}/failed", quota=0)
    assert sorted((r.label, r.tweet) for r in ingest.read_accepted(spark, f"{tmp_path}/accepted").collect()) == before[0]


def test_a_broken_line_is_kept(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    body = json.dumps({"output": {"choices": [{"text": json.dumps({"0": "a post of words"})}]}})
    (landing / "a.json").write_text(json.dumps({"label": 1, "body": body}) + '\n{"label": 2, "body": "cut off\n')
    places = [f"{tmp_path}/{name}" for name in ("accepted", "failed", "state")]
    ingest.ingest_responses(spark, str(landing), *places, available_now=True).awaitTermination()
    assert [r.tweet for r in ingest.read_accepted(spark, places[0]).collect()] == ["a post of words"]
    assert [(r.generated, r.reason) for r in ingest.read_failed(spark, places[1]).collect()] == [('{"label": 2, "body": "cut off', "bad_line")]


def test_the_quota_reads_counts_only(spark, tmp_path):
    accepted = f"{tmp_path}/accepted"
    spark.createDataFrame([(1, 5), (2, 1)], "label int, n long").write.parquet(f"{ingest.counts_path(accepted)}/batch_id=0")
    spark.createDataFrame([(1, 5), (2, 9)], "label int, n long").write.parquet(f"{ingest.counts_path(accepted)}/batch_id=1")
    assert ingest.full_classes(spark, accepted, 4, 1) == [1]
    assert sorted(ingest.full_classes(spark, accepted, 4, 2)) == [1, 2]


def test_validation_texts_are_not_trained_on(spark):
    human = spark.createDataFrame([(i, f"human post {i}", i % 3) for i in range(20)], "id long, tweet string, sentiment int")
    made = spark.createDataFrame([(i, f"human post {i}", 0) for i in range(20)] + [(50, "made up post", 1)], "id long, tweet string, sentiment int")
    train, validation = preparation.build_training_set(made, human, "id", mode=None)
    held = {r.text for r in validation.collect()}
    assert len(held) == 4 and not held & {r.text for r in train.collect()}
    leaky, _ = preparation.build_training_set(made, human, "id", mode=None, keep_leaks=True)
    assert held <= {r.text for r in leaky.collect()}
