"""Array expressions over class scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import fixed
from postmill.functions.bind import bind


def _col(values: Column | str) -> Column:
    return F.col(values) if isinstance(values, str) else values


def argmax(scores: Column | str) -> Column:
    """Position of the largest score, counted from 0; the first one of equals."""
    scores = _col(scores)
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def scores_in_order(records: Column | str, labels: Sequence[str] = fixed.SCORE_LABELS) -> Column:
    """Scores of an array of ``(label, score)`` records in the given label order."""
    entries = F.transform(_col(records), lambda r: F.struct(r["label"].alias("key"), r["score"].alias("value")))
    return bind(
        F.map_from_entries(entries),
        lambda by_label: F.array(*[F.element_at(by_label, F.lit(name)) for name in labels]),
    )


def softmax(logits: Column | str) -> Column:
    """Probabilities, shifted by the largest logit so that no power overflows."""
    powers = bind(
        _col(logits).cast("array<double>"),
        lambda v: bind(F.array_max(v), lambda peak: F.transform(v, lambda x: F.exp(x - peak))),
    )
    return bind(
        powers,
        lambda p: bind(
            F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x),
            lambda total: F.transform(p, lambda x: x / total),
        ),
    )


def topk(values: Column | str, k: int = 5) -> Column:
    """The ``k`` largest entries as ``(id, value)`` records, largest first, lower id first among equals."""
    ranked = F.array_sort(
        F.transform(_col(values), lambda x, i: F.struct((-x).alias("order"), i.alias("id"), x.alias("value")))
    )
    return F.transform(
        F.slice(ranked, 1, k), lambda r: F.struct(r["id"].alias("id"), r["value"].alias("value"))
    )


def token_of(vocab: DataFrame, hits: DataFrame, id_col: str = "id") -> DataFrame:
    """Add ``token``, looked up in ``vocab (token, id)``; NULL for an unknown id."""
    tokens = vocab.select("token", F.col("id").alias("_id"))
    return hits.join(tokens, hits[id_col] == tokens["_id"], "left").drop("_id")


def softmax_topk(logits: Column | str, k: int = 5) -> Column:
    return topk(softmax(logits), k)
