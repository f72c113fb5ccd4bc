"""Profiles and evaluation metrics. Every metric starts from a small table of counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.sources.scratch import materialise

MAX_CLASSES = 1_000


def class_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Rows per class, largest first; rows without a label are not counted."""
    counts = df.where(F.col(label_col).isNotNull()).groupBy(label_col).agg(F.count("*").alias("n_rows"))
    return counts.orderBy(F.desc("n_rows"), label_col)


def largest_class(df: DataFrame, label_col: str = "label") -> DataFrame:
    counts = df.where(F.col(label_col).isNotNull()).groupBy(label_col).agg(F.count("*").alias("n_rows"))
    return counts.agg(F.max("n_rows").alias("max_rows"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Every distinct row that occurs more than once, with its number of surplus copies."""
    counts = df.groupBy(*df.columns).agg(F.count("*").alias("n_copies"))
    return counts.where("n_copies > 1").withColumn("n_surplus", F.col("n_copies") - 1).drop("n_copies")


def profile_duplicates(df: DataFrame) -> DataFrame:
    """Number of rows that repeat an earlier row. Strings are compared by SHA-256, so texts are not shuffled."""
    strings = {f.name for f in df.schema if f.dataType.typeName() == "string"}
    keys = [F.sha2(c, 256).alias(c) if c in strings else F.col(c) for c in df.columns]
    counts = df.select(*keys).groupBy(*df.columns).agg((F.count("*") - 1).alias("n"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows"))


def profile_nulls(df: DataFrame) -> DataFrame:
    """Missing cells per column and in all, in one pass."""
    missing = {c: F.count_if(F.col(c).isNull()) for c in df.columns}
    per_column = [n.alias(f"null_{c}") for c, n in missing.items()]
    return df.agg(*per_column, sum(missing.values(), F.lit(0)).alias("null_cells"))


def confusion_counts(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """Rows per true and predicted class. Rows without a true class are left out; a missing prediction counts as wrong."""
    return df.where(F.col(true_col).isNotNull()).groupBy(F.col(true_col).alias("true"), F.col(pred_col).alias("pred")).agg(F.count("*").alias("n"))


def accuracy(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """Share of the rows with a true class whose prediction equals it; a missing prediction is wrong."""
    hit = F.coalesce(F.col(true_col) == F.col(pred_col), F.lit(False))
    return df.where(F.col(true_col).isNotNull()).agg(F.avg(hit.cast("int")).alias("accuracy"))


def class_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class from ``confusion_counts``; undefined values are zero."""
    hit = F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)
    as_true = F.struct(F.col("true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), hit.cast("long").alias("tp"))
    as_pred = F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp"))
    sides = counts.select(F.explode(F.array(as_true, as_pred)).alias("s")).select("s.*")
    totals = sides.where("label IS NOT NULL").groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])

    def ratio(top, bottom):
        return F.when(bottom > 0, top / bottom).otherwise(0.0)

    return totals.select(
        "label",
        "support",
        ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def weighted_f1(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """Mean of the per-class F1, weighted by the number of true rows of the class."""
    scores = class_scores(confusion_counts(df, true_col, pred_col))
    return scores.agg((F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def confusion_matrix(df: DataFrame, true_col: str, pred_col: str, labels: Sequence | None = None) -> DataFrame:
    """One row per true class and one column per predicted class, over the union of both."""
    return matrix_of(materialise(confusion_counts(df, true_col, pred_col), "confusion"), labels)


def matrix_of(counts: DataFrame, labels: Sequence | None = None, most: int = MAX_CLASSES) -> DataFrame:
    """The confusion matrix of written ``confusion_counts``. Without ``labels`` the classes are read from the counts;
    more than ``most`` of them are an error, since each is a column."""
    if labels is None:
        both = counts.select(F.explode(F.array("true", "pred")).alias("label")).where("label is not null")
        labels = sorted(row.label for row in both.distinct().limit(most + 1).collect())
        if len(labels) > most:
            raise ValueError(f"more than {most} classes")
    zeros = counts.sparkSession.createDataFrame([(x,) for x in labels], counts.select("true").schema).select(
        "true", F.col("true").alias("pred"), F.lit(0).cast("long").alias("n")
    )
    pivoted = counts.unionByName(zeros).groupBy("true").pivot("pred", list(labels)).agg(F.sum("n"))
    return pivoted.na.fill(0).where(F.col("true").isin(list(labels)))


def perplexity(df: DataFrame, loss_col: str = "loss", size_col: str = "n") -> DataFrame:
    """Exponential of the mean loss, weighted by batch size; infinite on overflow. Batches without a loss are left out."""
    size = F.when(F.col(loss_col).isNotNull(), F.col(size_col))
    mean = F.sum(F.col(loss_col) * size) / F.nullif(F.sum(size), F.lit(0))
    return df.agg(F.exp(mean).alias("perplexity"))


def metrics_report(df: DataFrame, true_col: str, pred_col: str, prefix: str = "test") -> DataFrame:
    """Accuracy and weighted F1 as ``(metric, value)`` rows, from one pass over the predictions."""
    return report_of(confusion_counts(df, true_col, pred_col), prefix)


def report_of(counts: DataFrame, prefix: str = "test", losses: DataFrame | None = None, loss_col: str = "loss", size_col: str = "n") -> DataFrame:
    """The report of ``confusion_counts``; with batch ``losses`` it has a perplexity row as well."""
    scored = class_scores(counts).agg(
        F.sum(F.col("recall") * F.col("support")).alias("hits"),
        F.sum(F.col("f1") * F.col("support")).alias("f1"),
        F.sum("support").alias("total"),
    )
    values = F.array(
        F.struct(F.lit(f"{prefix}/final_accuracy").alias("metric"), (F.col("hits") / F.col("total")).alias("value")),
        F.struct(F.lit(f"{prefix}/final_f1_score").alias("metric"), (F.col("f1") / F.col("total")).alias("value")),
    )
    report = scored.select(F.explode(values).alias("m")).select("m.*")
    if losses is None:
        return report
    return report.unionByName(perplexity(losses, loss_col, size_col).select(F.lit(f"{prefix}/perplexity").alias("metric"), F.col("perplexity").alias("value")))
