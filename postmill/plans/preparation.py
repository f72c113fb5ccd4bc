"""Corpora ready for training.

Plans that split a corpus first write its normalised form once: the split looks at the ids again, and later
readers of one side do not repeat the masking and the dedup shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions import fixed, text as tx
from postmill.functions.bind import with_once
from postmill.functions.labels import remap_labels
from postmill.operators.corpus import (
    TWEET_NAMES,
    combine_corpora,
    concat_splits,
    drop_missing,
    keep_first,
    min_words,
    project_text_label,
    rename_columns,
)
from postmill.operators.sampling import kfold, train_val_split
from postmill.operators.synonyms import balance
from postmill.sources.scratch import materialise


def normalise_corpus(df: DataFrame, id_col: str, keep: Sequence[str] = (), cashtags: bool = False) -> DataFrame:
    """Masked, distinct texts of at least two words, with their labels and the columns in ``keep``.

    Of texts that are equal after masking the one with the lowest id decides the label. Short texts go before
    the dedup: copies have the same length, so the result is the same and the shuffle smaller.
    """
    posts = drop_missing(project_text_label(df, [id_col, *keep]), ["text"])
    masked = with_once(posts, "text", tx.preprocess_text("text", cashtags))
    return keep_first(min_words(masked, 2), "text", id_col)


def prepare_pretraining(df: DataFrame, id_col: str, frac: float = 0.1, seed: int = 42) -> DataFrame:
    """Normalised posts without labels, with a ``split`` column."""
    normal = materialise(normalise_corpus(df.select(id_col, "text"), id_col), "pretraining")
    return train_val_split(normal, frac, id_col, seed)


def prepare_general_sentiment(splits: Mapping[str, DataFrame], id_col: str, frac: float = 0.1, seed: int = 42) -> DataFrame:
    """All published splits in one corpus, labels remapped, normalised and split anew."""
    merged = concat_splits(splits).drop("split")
    remapped = merged.withColumn("label", remap_labels("label", fixed.GENERAL_TO_CANONICAL))
    normal = materialise(normalise_corpus(remapped, id_col), "general-sentiment")
    return train_val_split(normal, frac, id_col, seed)


def prepare_finetuning(df: DataFrame, id_col: str, frac: float = 0.2, seed: int = 42) -> DataFrame:
    """Labelled posts, renamed, normalised and split."""
    normal = materialise(normalise_corpus(rename_columns(df, TWEET_NAMES), id_col), "finetuning")
    return train_val_split(normal, frac, id_col, seed)


def prepare_synthetic(df: DataFrame, id_col: str) -> DataFrame:
    return normalise_corpus(rename_columns(df, TWEET_NAMES), id_col)


def pretraining_folds(df: DataFrame, id_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Normalised posts without labels, with a ``fold`` column."""
    normal = materialise(normalise_corpus(df.select(id_col, "text"), id_col), "pretraining")
    return kfold(normal, id_col, k, seed)


def build_training_set(
    synthetic: DataFrame,
    human: DataFrame,
    id_col: str,
    mode: str | None = "simple",
    frac: float = 0.2,
    seed: int = 42,
    draw_seed: int = 0,
    synonyms: DataFrame | None = None,
    keep_leaks: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Balanced training rows from both corpora, and the validation rows of the human one as they are.

    Ids may repeat across the corpora, so training rows are told apart by ``row_id``, ``<corpus>:<id>``. Synthetic posts
    whose normalised text is a validation text are left out of training, unless ``keep_leaks``.
    """
    split = prepare_finetuning(human, id_col, frac, seed)
    made = prepare_synthetic(synthetic, id_col)
    if not keep_leaks:
        held = split.where("split = 'validation'").select(F.xxhash64("text").alias("_hash"), F.col("text").alias("_text"))
        made = made.join(held, (F.xxhash64("text") == F.col("_hash")) & (F.col("text") == F.col("_text")), "left_anti")
    training = combine_corpora(
        {"synthetic": made, "human": split.where("split = 'train'").drop("split")}
    )
    row_id = F.concat_ws(":", F.col("corpus"), F.col(id_col).cast("string"))
    training = materialise(training.withColumn("row_id", row_id), "training")
    balanced = balance(training, mode, "row_id", seed=draw_seed, synonyms=synonyms)
    return balanced, split.where("split = 'validation'").drop("split")


def held_out_for_perplexity(df: DataFrame, id_col: str, frac: float = 0.2, seed: int = 42) -> DataFrame:
    """The texts perplexity is measured on: the training side of the finetuning corpus."""
    return prepare_finetuning(df, id_col, frac, seed).where("split = 'train'").select(id_col, "text")
