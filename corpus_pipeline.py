"""A corpus pipeline: quality, near duplicates, benchmark passages, mixture, shards.

Every stage takes all documents its predecessor kept and is written before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import decontaminate, mixing, quality, sharding, simhash
from postmill.llm.common import materialise, read_table, with_place
from postmill.llm.queries import SHARDS, WEIGHTS
from postmill.session import ship_package


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier does not reject."""
    model = quality.fit_classifier(docs, read_table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model, score_col="_score")
    return scored.where(F.col("_score") >= 0.5).drop("_score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the one with the smallest id."""
    return simhash.keep_one(docs, materialise(simhash.simhash_groups(docs), "simhash-groups"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than one in twenty is in a benchmark passage."""
    return decontaminate.remove_contamination(docs, read_table(spark, sf_dir, "benchmark"))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the schedule takes them from their sources; shards and slots follow it."""
    return mixing.mixed_order(docs, WEIGHTS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` of all documents, dealt to the shards in the order they come in."""
    return sharding.shard_documents(with_place(docs, "_at"), SHARDS, order_col="_at").withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixture),
    ("sharding", shards),
]

#: SQL can express neither the classifier nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
