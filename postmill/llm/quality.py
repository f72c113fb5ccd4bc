"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

Terms of a text are trigrams of character classes, hashed words, and steps of four statistics (repeated lines,
repeated words, word length, number of words). Labelled texts, a bounded sample, give term weights and a latent space
by truncated singular value decomposition. The labelled vectors are broadcast; every text is projected, compared with
all of them in exact blocked cosine products, and takes the labels of its nearest ones weighted by similarity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABELLED = 4_000  # labelled rows the classifier is fitted on, at most
DIMENSIONS = 64
NEIGHBOURS = 25
SHARPNESS = 8  # a neighbour's weight is its similarity to this power
WORD_TERMS = 1_024
TEXT_BLOCK = 1 << 20  # bytes of a text whose trigrams are counted at once
ROW_BLOCK = 512  # texts compared at once

_CLASSES = 12
_SHAPES = _CLASSES**3
_STEPS = 10
_TERMS = _SHAPES + WORD_TERMS + 4 * _STEPS


def _class_table() -> np.ndarray:
    table = np.full(256, 9, dtype=np.int32)  # other signs
    for kind, signs in (
        (0, "abcdefghijklmnopqrstuvwxyz"), (1, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, "0123456789"), (4, " "),
        (5, "\t\n\v\f\r"), (6, "."), (7, ","), (8, "'\"-:;()?"), (10, "!"), (11, "|/\\_<>{}[]="),
    ):
        table[[ord(s) for s in signs]] = kind
    table[128:] = 3
    return table


_CLASS = _class_table()


def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices and counts of the terms of a whole text."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    counts = np.zeros(_TERMS, dtype=np.float32)
    for lo in range(0, max(len(data) - 2, 0), TEXT_BLOCK):
        kinds = _CLASS[data[lo : lo + TEXT_BLOCK + 2]]
        counts[:_SHAPES] += np.bincount((kinds[:-2] * _CLASSES + kinds[1:-1]) * _CLASSES + kinds[2:], minlength=_SHAPES)
    words = text.lower().encode().split()
    crc = zlib.crc32
    if words:
        counts[_SHAPES : _SHAPES + WORD_TERMS] = np.bincount([crc(w) % WORD_TERMS for w in words], minlength=WORD_TERMS)
    lines = text.split("\n")
    length = sum(map(len, words)) / len(words) if words else 0
    steps = (
        10 * (1 - len(set(lines)) / len(lines)),
        10 * (1 - len(set(words)) / len(words)) if words else 0,
        length,
        float(np.log2(len(words) + 1)),
    )
    for i, step in enumerate(steps):
        counts[_SHAPES + WORD_TERMS + i * _STEPS + min(int(step), _STEPS - 1)] = 1
    found = np.flatnonzero(counts)
    return found.astype(np.int32), counts[found]


_PARTS = ((0, _SHAPES, 1.0), (_SHAPES, _SHAPES + WORD_TERMS, 0.7), (_SHAPES + WORD_TERMS, _TERMS, 1.0))


def _matrix(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Log counts per 1,000 of a kind of term; the steps as they are."""
    out = np.zeros((len(rows), _TERMS), dtype=np.float32)
    for row, (found, counts) in zip(out, rows):
        row[found] = counts
    for lo, hi, _ in _PARTS[:2]:
        part = out[:, lo:hi]
        part *= 1000 / np.maximum(part.sum(axis=1, keepdims=True), 1)
        np.log1p(part, out=part)
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


@dataclass
class Classifier:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def _weighted(self, rows: np.ndarray) -> np.ndarray:
        rows = rows * self.idf
        for lo, hi, weight in _PARTS:
            rows[:, lo:hi] = _unit(rows[:, lo:hi]) * weight
        return rows

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Classifier:
        counts = _matrix(rows)
        idf = (np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 0.1).astype(np.float32)
        made = cls(idf, np.empty(0), np.empty(0), labels.astype(np.float32))
        weighted = made._weighted(counts)
        # Leading right singular vectors by subspace iteration.
        axes = np.random.default_rng(0).standard_normal((_TERMS, DIMENSIONS)).astype(np.float32)
        for _ in range(12):
            axes, _ = np.linalg.qr(weighted.T @ (weighted @ axes))
        made.axes = axes
        made.vectors = _unit(weighted @ axes)
        return made

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        vectors = _unit(self._weighted(_matrix(rows)) @ self.axes)
        cosine = vectors @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        nearest = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(cosine, nearest, axis=1), 1e-3, 1).astype(np.float64) ** SHARPNESS
        return np.clip((weight * self.labels[nearest]).sum(axis=1) / weight.sum(axis=1), 0, 1)


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learnt from: CRC-32 of the id as text leaves remainder 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit_classifier(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", n_labelled: int = LABELLED) -> Classifier | None:
    """Fit on ``n_labelled`` labelled rows outside the held-out part, taken by the hash of their id.

    The driver gets the term counts of this sample only, at most ``n_labelled`` sparse rows. None without any label.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.avg(label_col).alias("_label"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(n_labelled)
    texts = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    texts = texts.join(F.broadcast(sample), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.first("_label").alias("_label"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [terms(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32()))],
                names=["label", "found", "counts"],
            )

    rows = texts.select("_label", "_text").mapInArrow(counted, "label double, found array<int>, counts array<float>").toArrow()
    if not rows.num_rows:
        return None
    pairs = [(np.array(f.values), np.array(c.values)) for f, c in zip(rows["found"], rows["counts"])]
    return Classifier.fit(pairs, rows["label"].to_numpy())


def quality_score(spark: SparkSession, model: Classifier | None, text_col: str = "text") -> Column:
    """Score of a text from 0 to 1: the similarity-weighted share of label 1 among the nearest labelled texts.

    The whole text is read and nothing but the text. A NULL text counts as empty and is scored like any short text; rows
    with equal texts get equal scores. Without a model (no labels) every score is 0.5. A narrow step; the broadcast
    model is bounded by its parameters.
    """
    if model is None:
        return F.lit(0.5)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        parts = [texts.iloc[lo : lo + ROW_BLOCK] for lo in range(0, len(texts), ROW_BLOCK)]
        scores = [shared.value.score([terms(t or "") for t in part]) for part in parts]
        return pd.Series(np.concatenate(scores) if scores else np.empty(0))

    return score(F.col(text_col))


def score_quality(df: DataFrame, model: Classifier | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All rows and columns of ``df`` with ``score_col``; repeated rows give repeated results."""
    return df.withColumn(score_col, quality_score(df.sparkSession, model, text_col))
