"""Scored tables to metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions import fixed
from postmill.functions.labels import decode_labels, harmonise_predictions
from postmill.operators.metrics import confusion_counts, matrix_of, report_of
from postmill.sources.scratch import materialise


def label_pairs(scored: DataFrame, category: str, true_col: str = "label", pred_col: str = "predicted") -> DataFrame:
    """``(true, pred)`` class names.

    ``finetune`` decodes label codes and lower-cases predictions; ``test`` has named classes and expresses
    predictions as positive, negative or neutral.
    """
    if category == "finetune":
        return scored.select(decode_labels(true_col, fixed.SENTIMENT_CODES).alias("true"), F.lower(pred_col).alias("pred"))
    if category == "test":
        return scored.select(F.col(true_col).alias("true"), harmonise_predictions(pred_col).alias("pred"))
    raise ValueError(f"unknown category {category!r}")


def evaluate(
    scored: DataFrame, category: str, true_col: str = "label", pred_col: str = "predicted", losses: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Metrics report and confusion matrix of a scored table; ``losses`` adds a perplexity row to the report.

    Both come from one written table of counts, so a prediction in ``scored`` is made once.
    """
    counts = materialise(confusion_counts(label_pairs(scored, category, true_col, pred_col), "true", "pred"), "confusion")
    return report_of(counts, "test", losses), matrix_of(counts)
