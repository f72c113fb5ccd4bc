"""Generator responses, as they arrive, into accepted posts and failed generations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postmill.functions import fixed
from postmill.operators.generated import accepted_and_failed, parse_responses
from postmill.operators.sampling import number_in_class
from postmill.sources.scratch import hadoop_fs

RESPONSES = "label int, body string"
BROKEN = "_corrupt_record"
ACCEPTED = "label int, position int, tweet string"
FAILED = "label int, generated string, reason string"
COUNTS = "label int, n long"


def counts_path(accepted_path: str) -> str:
    """Accepted posts per class and batch, a few rows each, next to the accepted posts."""
    return f"{accepted_path.rstrip('/')}_counts"


def accepted_before(spark: SparkSession, accepted_path: str, before_batch: int) -> dict[int, int]:
    """Accepted posts per class from batches before ``before_batch``; reads the counts only."""
    fs, path = hadoop_fs(spark, counts_path(accepted_path))
    if not fs.exists(path):
        return {}
    counts = spark.read.schema(f"{COUNTS}, batch_id long").parquet(counts_path(accepted_path))
    totals = counts.where(F.col("batch_id") < before_batch).groupBy("label").agg(F.sum("n").alias("n"))
    # One row per class code of the generator, so a handful.
    return {row.label: row.n for row in totals.collect()}


def full_classes(spark: SparkSession, accepted_path: str, quota: int, before_batch: int) -> list[int]:
    """Classes with more than ``quota`` accepted posts from batches before ``before_batch``."""
    return [label for label, n in accepted_before(spark, accepted_path, before_batch).items() if n > quota]


def split_at_quota(accepted: DataFrame, before: Mapping[int, int], quota: int) -> tuple[DataFrame, DataFrame]:
    """The posts that still have room in their class, and the others.

    Which posts of a class stay is decided by a hash of the post, so a replay decides alike. Posts are numbered only in
    classes that this batch would overfill, per class and hash prefix, so no task sees a whole class. Posts without a
    class have no quota.
    """
    room = F.lit(quota)
    for label, n in before.items():
        room = F.when(F.col("label") == label, F.lit(max(quota - n, 0))).otherwise(room)
    counts = accepted.where(F.col("label").isNotNull()).groupBy("label").agg(F.count("*").alias("n"))
    crowded = [row.label for row in counts.where(F.col("n") > room).select("label").collect()]
    if not crowded:
        return accepted, accepted.limit(0)
    tight = F.coalesce(F.col("label").isin(crowded), F.lit(False))
    key = F.md5(F.concat_ws(":", "position", "tweet"))
    ranked = number_in_class(accepted.where(tight).withColumn("_key", key), "label", ["position", "tweet"])
    stays, goes = (ranked.where(side).select(*accepted.columns) for side in (F.col("rank") < room, F.col("rank") >= room))
    return accepted.where(~tight).unionByName(stays), goes


def write_batch(batch: DataFrame, batch_id: int, accepted_path: str, failed_path: str, quota: int, hard_quota: bool = False) -> None:
    """Parse one batch and write its two sides under its own folder, so that a replay overwrites itself.

    Responses of a class that was full before the batch go to the failed side, unparsed, and so do lines that are no
    JSON object of the expected form. With ``hard_quota`` so do the posts a class has no room for.
    """
    before = accepted_before(batch.sparkSession, accepted_path, batch_id)
    full = [label for label, n in before.items() if n > quota or (hard_quota and n == quota)]
    broken = F.col(BROKEN).isNotNull() if BROKEN in batch.columns else F.lit(False)
    is_full = F.coalesce(F.col("label").isin(full), F.lit(False)) if full else F.lit(False)
    parsed = parse_responses(batch.where(~broken & ~is_full).select("label", "body")).persist()
    accepted, failed = accepted_and_failed(parsed)
    over = batch.where(~broken & is_full).select("label", F.col("body").alias("generated"), F.lit("over_quota").alias("reason"))
    if hard_quota:
        accepted, beyond = split_at_quota(accepted, before, quota)
        over = over.unionByName(beyond.select("label", F.col("tweet").alias("generated"), F.lit("over_quota").alias("reason")))
    failed = failed.unionByName(over)
    if BROKEN in batch.columns:
        failed = failed.unionByName(batch.where(broken).select("label", F.col(BROKEN).alias("generated"), F.lit("bad_line").alias("reason")))
    target = f"{accepted_path}/batch_id={batch_id}"
    accepted.write.mode("overwrite").parquet(target)
    failed.write.mode("overwrite").parquet(f"{failed_path}/batch_id={batch_id}")
    counts = batch.sparkSession.read.schema(ACCEPTED).parquet(target).groupBy("label").agg(F.count("*").alias("n"))
    counts.coalesce(1).write.mode("overwrite").parquet(f"{counts_path(accepted_path)}/batch_id={batch_id}")
    parsed.unpersist()


def ingest_responses(
    spark: SparkSession,
    landing: str,
    accepted_path: str,
    failed_path: str,
    checkpoint: str,
    quota: int = fixed.CLASS_QUOTA,
    files_per_batch: int = 1_000,
    available_now: bool = False,
    hard_quota: bool = False,
) -> StreamingQuery:
    """Start the stream over a folder of JSON lines ``{"label": code, "body": response}``.

    A body that is no response, or holds no usable post, is kept on the failed side with a reason, and so is the text of
    a line that is broken; nothing is lost and nothing stops the stream. The quota is looked up once per batch, so a class may overshoot
    by one batch. With ``hard_quota`` a class ends with exactly ``quota`` posts, and the posts beyond it are kept on the
    failed side.
    """
    schema = f"{RESPONSES}, {BROKEN} string"
    source = spark.readStream.schema(schema).options(maxFilesPerTrigger=files_per_batch, columnNameOfCorruptRecord=BROKEN).json(landing)
    writer = source.writeStream.foreachBatch(
        lambda batch, batch_id: write_batch(batch, batch_id, accepted_path, failed_path, quota, hard_quota)
    ).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_accepted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{ACCEPTED}, batch_id long").parquet(path)


def read_failed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{FAILED}, batch_id long").parquet(path)
