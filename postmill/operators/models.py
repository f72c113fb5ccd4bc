"""Batch scoring with a supplied predictor, and a Spark ML baseline for the three-class task."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions import text as tx
from postmill.operators.metrics import accuracy
from postmill.sources.scratch import hadoop_fs, materialise

_TEXT = "_baseline_text"
FEATURES = 1 << 16

Predictor = Callable[[Sequence[str]], Sequence[tuple[str, float]]]


def score_corpus(df: DataFrame, make_predictor: Callable[[], Predictor], text_col: str = "text", batch_size: int = 32) -> DataFrame:
    """Add ``prediction``, a ``(label, score)`` record per text.

    ``make_predictor`` loads the model once per Python worker, which keeps it over its tasks; the predictor it returns
    gets at most ``batch_size`` texts at a time. Only the text column reaches Python; a NULL text has no prediction.
    """

    def make_predict() -> Callable[[np.ndarray], dict[str, np.ndarray]]:
        predictor = make_predictor()

        def predict(texts: np.ndarray) -> dict[str, np.ndarray]:
            labels, scores = np.full(len(texts), None, dtype=object), np.full(len(texts), np.nan)
            known = [i for i, text in enumerate(texts) if text is not None]
            for i, (label, score) in zip(known, predictor([texts[i] for i in known]) if known else ()):
                labels[i], scores[i] = label, score
            return {"label": labels, "score": scores}

        return predict

    schema = T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])
    predicted = predict_batch_udf(make_predict, return_type=schema, batch_size=batch_size)(F.col(text_col))
    nothing = F.struct(F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("score"))
    return df.withColumn("prediction", F.when(F.col(text_col).isNotNull(), predicted).otherwise(nothing))


@dataclass(frozen=True)
class WordCounts:
    """Rows ``(label, tf_<n>, ...)`` of a corpus, written: a label and the word counts of its text, hashed into n features."""

    rows: DataFrame
    text_col: str


def _hashing(features: int, column: str = "tf") -> HashingTF:
    return HashingTF(inputCol="tokens", outputCol=column, numFeatures=features)


def _tokenising(text_col: str) -> list[Transformer]:
    return [
        SQLTransformer(statement=f"SELECT *, coalesce(`{text_col}`, '') AS {_TEXT} FROM __THIS__"),
        RegexTokenizer(inputCol=_TEXT, outputCol="tokens", pattern=f"[{tx.SPACE}]+", toLowercase=True),
    ]


def count_words(df: DataFrame, features: Collection[int], text_col: str = "text", label_col: str = "label") -> WordCounts:
    """Cut every text into words once, for all sizes in ``features``. Rows without a label are left out."""
    sizes = sorted(set(features))
    counted = df.where(F.col(label_col).isNotNull()).select(text_col, label_col)
    for stage in [*_tokenising(text_col), *[_hashing(n, f"tf_{n}") for n in sizes]]:
        counted = stage.transform(counted)
    return WordCounts(materialise(counted.select(label_col, *[f"tf_{n}" for n in sizes]), "word-counts"), text_col)


def fit_sentiment_baseline(
    train: DataFrame | WordCounts, text_col: str = "text", label_col: str = "label", features: int = FEATURES, max_iter: int = 20, regularisation: float = 0.01
) -> PipelineModel:
    """Fit TF-IDF features and a multinomial logistic regression; all passes are Spark jobs over the rows.

    Words are the library's words. Rows without a text or a label are left out; predicting a NULL text is predicting an
    empty one. The passes read word counts that are written first; to fit several times, write them once by ``count_words``.
    """
    if isinstance(train, DataFrame):
        train = count_words(train.where(F.col(text_col).isNotNull()), [features], text_col, label_col)
    counts = train.rows.select(label_col, F.col(f"tf_{features}").alias("tf"))
    idf = IDF(inputCol="tf", outputCol="features").fit(counts)
    regression = LogisticRegression(labelCol=label_col, featuresCol="features", family="multinomial", maxIter=max_iter, regParam=regularisation)
    return PipelineModel([*_tokenising(train.text_col), _hashing(features), idf, regression.fit(idf.transform(counts))])


def predict_baseline(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add the predicted class code as ``predicted``."""
    scored = model.transform(df)
    return scored.select(*df.columns, F.col("prediction").cast("int").alias("predicted"))


def _accuracy(model: PipelineModel, counts: WordCounts, label_col: str) -> DataFrame:
    """The model's accuracy on rows whose words are counted: the stages after the hashing are what is left to do."""
    *_, hashing, idf, regression = model.stages
    tf = counts.rows.select(label_col, F.col(f"tf_{hashing.getNumFeatures()}").alias("tf"))
    scored = regression.transform(idf.transform(tf)).select(label_col, F.col("prediction").cast("int").alias("predicted"))
    return accuracy(scored, label_col, "predicted")


@dataclass(frozen=True)
class Chosen:
    """The candidate that did best on the validation rows, and the accuracy of every one, in the order of the grid."""

    model: PipelineModel
    candidate: Mapping[str, float]
    accuracies: list[float]


def choose_baseline(
    train: DataFrame, validation: DataFrame, grid: Sequence[Mapping[str, float]], path: str, text_col: str = "text", label_col: str = "label"
) -> Chosen:
    """Fit a baseline for every candidate of ``grid`` on ``train`` and keep the most accurate one on ``validation``; of equal
    ones the first.

    A candidate holds arguments of ``fit_sentiment_baseline``. Its model and accuracy are written under ``path``, by a
    digest of these arguments, as soon as they are known: a search that was stopped goes on with the candidates that are left.
    Texts are cut into words once for all of these, and every pass of a fit reads the written counts.
    A path belongs to one pair of tables. Validation rows without a label do not count.
    """
    if not grid:
        raise ValueError("the grid has no candidate")
    spark, found = train.sparkSession, []
    owns = [f"{path.rstrip('/')}/{hashlib.sha1(json.dumps(dict(c), sort_keys=True).encode()).hexdigest()}" for c in grid]

    def done(own: str) -> bool:
        fs, success = hadoop_fs(spark, f"{own}/accuracy/_SUCCESS")
        return fs.exists(success)

    sizes = [c.get("features", FEATURES) for c, own in zip(grid, owns) if not done(own)]
    if sizes:
        known = count_words(train.where(F.col(text_col).isNotNull()), sizes, text_col, label_col)
        held = count_words(validation, sizes, text_col, label_col)
    for candidate, own in zip(grid, owns):
        if not done(own):
            model = fit_sentiment_baseline(known, text_col, label_col, **candidate)
            model.write().overwrite().save(f"{own}/model")
            _accuracy(model, held, label_col).write.mode("overwrite").parquet(f"{own}/accuracy")
        share = spark.read.parquet(f"{own}/accuracy").first().accuracy
        found.append((-1.0 if share is None else share, own))
    best = max(range(len(found)), key=lambda i: (found[i][0], -i))
    return Chosen(PipelineModel.load(f"{found[best][1]}/model"), dict(grid[best]), [share for share, _ in found])
