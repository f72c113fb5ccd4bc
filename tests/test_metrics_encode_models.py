import math
import os

import pytest
from pyspark.sql import functions as F

from postmill.operators import corpus, encode, metrics, models
from postmill.plans import evaluation


def pairs(spark, true, pred):
    return spark.createDataFrame(list(zip(true, pred)), "t string, p string")


def test_weighted_f1(spark):
    df = pairs(spark, ["a", "a", "b"], ["a", "b", "b"])
    assert metrics.weighted_f1(df, "t", "p").first()[0] == pytest.approx(2 / 3)
    assert metrics.accuracy(df, "t", "p").first()[0] == pytest.approx(2 / 3)
    report = {r.metric: r.value for r in metrics.metrics_report(df, "t", "p").collect()}
    assert report == {"test/final_accuracy": pytest.approx(2 / 3), "test/final_f1_score": pytest.approx(2 / 3)}


def test_matrix_covers_classes_that_are_only_predicted(spark):
    rows = metrics.confusion_matrix(pairs(spark, ["a"], ["c"]), "t", "p").orderBy("true").collect()
    assert [r.asDict() for r in rows] == [{"true": "a", "a": 0, "c": 1}, {"true": "c", "a": 0, "c": 0}]


def test_perplexity(spark):
    df = spark.createDataFrame([(1.0, 16), (2.0, 8)], "loss double, n int")
    assert metrics.perplexity(df).first()[0] == pytest.approx(math.exp(4 / 3))
    assert metrics.perplexity(df.withColumn("loss", F.lit(800.0))).first()[0] == math.inf
    assert metrics.perplexity(df.where("n < 0")).first()[0] is None


def test_profiles(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 1), ("b", None), ("b", None), (None, 2)], "tweet string, sentiment int")
    assert metrics.profile_duplicates(df).first()[0] == 3
    assert {(r.tweet, r.sentiment, r.n_surplus) for r in metrics.duplicate_rows(df).collect()} == {("a", 1, 2), ("b", None, 1)}
    assert metrics.profile_nulls(df).first().asDict() == {"null_tweet": 1, "null_sentiment": 2, "null_cells": 3}
    assert [tuple(r) for r in metrics.class_counts(df, "sentiment").collect()] == [(1, 3), (2, 1)]
    assert [tuple(r) for r in corpus.clean_main(df).collect()] == [("a", 1)]
    assert metrics.profile_duplicates(df.distinct()).first()[0] == 0


def test_evaluate(spark):
    scored = spark.createDataFrame([(0, "NEUTRAL"), (1, "BEARISH")], "label int, predicted string")
    report, matrix = evaluation.evaluate(scored, "finetune")
    assert {r.metric: r.value for r in report.collect()}["test/final_accuracy"] == 0.5
    assert sorted(r.true for r in matrix.collect()) == ["bearish", "bullish", "neutral"]
    named = spark.createDataFrame([("positive", "BULLISH"), ("negative", "neutral")], "label string, predicted string")
    assert evaluation.label_pairs(named, "test").collect() == [("positive", "positive"), ("negative", "neutral")]
    with pytest.raises(ValueError):
        evaluation.label_pairs(named, "other")


def vocab(spark):
    tokens = encode.SPECIAL + ["up", "##s", "##side", "u", "!", "moon"]
    return spark.createDataFrame([(t, i) for i, t in enumerate(tokens)], "token string, id int")


def test_encoding(spark):
    texts = [(1, "Ups upside @USER [URL] moon!"), (2, ""), (3, "x ups"), (4, "moon " * 20), (5, None)]
    df = spark.createDataFrame(texts, "id long, text string")
    out = {r.id: r for r in encode.encode_corpus(df, vocab(spark), "id", max_len=12).collect()}
    assert out[1].input_ids == [2, 7, 8, 7, 9, 5, 6, 12, 11, 3, 0, 0]
    assert out[1].attention_mask == [1] * 10 + [0] * 2
    assert out[2].input_ids == [2, 3] + [0] * 10 and out[5].input_ids == out[2].input_ids
    assert out[3].input_ids == [2, 1, 7, 8, 3] + [0] * 7
    assert out[4].input_ids == [2] + [12] * 10 + [3]
    assert all(len(r.token_type_ids) == 12 and set(r.token_type_ids) == {0} for r in out.values())
    chosen = corpus.training_columns(encode.encode_corpus(df, vocab(spark), "id"), "pretrain")
    assert chosen.columns == ["input_ids", "attention_mask"] and len(chosen.first().input_ids) == 512


def test_masking(spark):
    df = spark.range(400).withColumn("input_ids", F.array_repeat(F.lit(50), 100))
    out = encode.mlm_mask(df, "id", vocab_size=1000, mask_id=4, special_ids=[0, 2, 3]).collect()
    tokens = [(t, y) for r in out for t, y in zip(r.input_ids, r.labels)]
    chosen = [t for t, y in tokens if y != -100]
    assert all(t == 50 for t, y in tokens if y == -100) and all(y in (50, -100) for _, y in tokens)
    assert len(chosen) / len(tokens) == pytest.approx(0.15, abs=0.01)
    assert chosen.count(4) / len(chosen) == pytest.approx(0.8, abs=0.03)
    assert chosen.count(50) / len(chosen) == pytest.approx(0.1, abs=0.03)
    special = encode.mlm_mask(df.withColumn("input_ids", F.array_repeat(F.lit(2), 50)), "id", 1000, 4, [2])
    assert special.where(F.array_max("labels") > -100).count() == 0


def test_scoring(spark):
    def make_predictor():
        return lambda texts: [(f"N{len(texts)}", float(len(t))) for t in texts]

    df = spark.createDataFrame([(i, "x" * i) for i in range(5)] + [(9, None)], "id long, text string").coalesce(1)
    out = {r.id: r.prediction for r in models.score_corpus(df, make_predictor, batch_size=2).collect()}
    assert out[9].label is None and [out[i].score for i in range(5)] == [0.0, 1.0, 2.0, 3.0, 4.0]
    assert {p.label for p in out.values() if p.label} == {"N2", "N1"}


def test_a_worker_loads_the_model_once(spark, tmp_path):
    log = f"{tmp_path}/loads"

    def make_predictor():
        with open(log, "a") as out:
            out.write(f"{os.getpid()}\n")
        return lambda texts: [("N", 1.0) for _ in texts]

    df = spark.createDataFrame([(f"t{i}",) for i in range(64)], "text string").repartition(16)
    assert models.score_corpus(df, make_predictor, batch_size=2).where("prediction.score = 1").count() == 64
    loads = open(log).read().split()
    assert 0 < len(loads) == len(set(loads)) <= 8


def test_baseline_learns_obvious_words(spark):
    rows = [(f"{w} thing {i}", c) for c, w in enumerate(["flat", "up", "down"]) for i in range(15)]
    df = spark.createDataFrame(rows, "text string, label int")
    model = models.fit_sentiment_baseline(df, features=1 << 8, max_iter=10)
    assert models.predict_baseline(model, df).where("label = predicted").count() >= 43


def test_missing_predictions_and_losses(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", None), ("b", "b"), ("b", "b"), (None, "a")], "true string, pred string")
    assert metrics.accuracy(rows, "true", "pred").first().accuracy == 0.75
    report = {r.metric: r.value for r in metrics.metrics_report(rows, "true", "pred").collect()}
    assert report["test/final_accuracy"] == 0.75
    losses = spark.createDataFrame([(1.0, 10), (None, 10)], "loss double, n long")
    assert abs(metrics.perplexity(losses).first().perplexity - 2.718281828) < 1e-6
    with pytest.raises(ValueError):
        metrics.matrix_of(metrics.confusion_counts(rows, "true", "pred"), most=1)


def test_predictions_are_made_once(spark, tmp_path):
    log = f"{tmp_path}/calls"

    def make():
        def predict(texts):
            with open(log, "a") as out:
                out.write("x" * len(texts))
            return [("NEUTRAL", 1.0) for _ in texts]

        return predict

    texts = spark.createDataFrame([(i % 3, f"t{i}") for i in range(40)], "label int, text string")
    scored = models.score_corpus(texts, make).withColumn("predicted", F.col("prediction.label"))
    report, matrix = evaluation.evaluate(scored, "finetune")
    assert report.count() == 2 and matrix.count() == 3
    assert len(open(log).read()) == 40


def test_long_words_and_plan_of_encoding(spark, monkeypatch):
    df = spark.createDataFrame([(1, "ab" * 90 + " ab zz"), (2, None), (3, "")], "id long, text string")
    own = spark.createDataFrame([(t, i) for i, t in enumerate([*encode.SPECIAL, "ab", "##ab"])], "token string, id int")
    encoded = encode.encode_corpus(df, own, "id", max_len=400)
    assert "Exchange" not in encoded._jdf.queryExecution().executedPlan().toString()
    one = {r.id: (r.input_ids, r.attention_mask) for r in encoded.collect()}
    assert one[1][0][:94] == [2, 7, *[8] * 89, 7, 1, 3] and sum(one[1][1]) == 94
    monkeypatch.setattr(encode, "BROADCAST_TOKENS", 0)
    assert {r.id: (r.input_ids, r.attention_mask) for r in encode.encode_corpus(df, own, "id", max_len=400).collect()} == one


def test_baseline_with_missing_texts(spark):
    rows = [("good \u00a0fine", 1), ("bad poor", 2), ("so so", 0), (None, 1), ("x", None)] * 5
    df = spark.createDataFrame(rows, "text string, label int")
    model = models.fit_sentiment_baseline(df, features=1 << 8, max_iter=5)
    assert models.predict_baseline(model, df).where("predicted IN (0, 1, 2)").count() == 25
