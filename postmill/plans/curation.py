"""Curating generated posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import fixed
from postmill.functions.labels import encode_labels
from postmill.operators.band_index import BandIndex, text_name
from postmill.operators.corpus import clean_main, drop_ids, drop_missing, merge_generated
from postmill.operators.metrics import class_counts, profile_duplicates, profile_nulls
from postmill.operators.neardup import Signed, overlapping, remove_near_duplicates, remove_overlap, sign_corpus, signed_groups
from postmill.operators.skew import attach
from postmill.sources.scratch import materialise


def curate_synthetic(
    main: DataFrame, generated: DataFrame, human: DataFrame, id_col: str, human_id_col: str | None = None, verify: bool = False, **search
) -> DataFrame:
    """Merge new posts into the main table, clean it, and drop near copies within it and of human posts.

    Every distinct text is signed once: the bands of the posts that survive the first step serve the second. With
    ``verify`` both steps check similarities.
    """
    cleaned = materialise(clean_main(merge_generated(main, generated), id_col=id_col), "cleaned")
    human_id = human_id_col or id_col
    if verify or search.get("grouping", "components") != "components":
        distinct = remove_near_duplicates(cleaned, id_col, "tweet", verify=verify, **search)
        overlap = {k: v for k, v in search.items() if k != "grouping"}
        return remove_overlap(distinct, human, id_col, "tweet", base_id_col=human_id, base_text_col="tweet", verify=verify, **overlap)
    search.pop("grouping", None)
    ours = sign_corpus(cleaned, id_col, "tweet", **search)
    theirs = sign_corpus(human, human_id, "tweet", **search)
    near = materialise(signed_groups(ours).where("id <> group_id").select("id"), "near-copies")
    left = Signed(ours.bands.join(near, "id", "left_anti"), ours.copies.join(near, "id", "left_anti"))
    dropped = near.unionByName(overlapping(left, theirs)).withColumnRenamed("id", id_col)
    return drop_ids(cleaned, dropped, id_col)


class Curation:
    """Curation of a main table that grows by batches, kept under ``path``, a folder all executors share.

    Batches of posts and of human texts are added as they come; each signs its new texts only. ``result`` equals
    ``curate_synthetic`` over all batches at once, in whatever order the ids came.
    """

    def __init__(self, spark: SparkSession, path: str, id_col: str, **search) -> None:
        self.spark, self.path, self.id_col = spark, path.rstrip("/"), id_col
        self.ours = BandIndex(spark, f"{self.path}/ours", **search)
        self.theirs = BandIndex(spark, f"{self.path}/human", **search)

    def add_posts(self, posts: DataFrame, batch: int) -> int:
        """Add posts ``(id, tweet, sentiment, ...)``, labels by code or by name; those without a text or a label are left out. Returns how many texts were signed."""
        if posts.schema["sentiment"].dataType.typeName() == "string":
            posts = posts.withColumn("sentiment", encode_labels("sentiment", dict(fixed.SENTIMENT_CODES)))
        cleaned = drop_missing(posts.withColumn("sentiment", F.col("sentiment").cast("int")), ["tweet", "sentiment"])
        cleaned.withColumn("_name", text_name("tweet")).write.mode("overwrite").parquet(f"{self.path}/posts/batch={batch}")
        written = self.spark.read.parquet(f"{self.path}/posts/batch={batch}")
        return self.ours.add(written.select("tweet", "_name"), batch, "tweet", "_name")

    def add_human(self, texts: DataFrame, batch: int) -> int:
        """Add human texts ``(tweet, ...)`` that posts must not come near to. Returns how many were signed."""
        return self.theirs.add(texts.select("tweet"), batch, "tweet")

    def result(self) -> DataFrame:
        """The posts kept so far: of every group the one with the lowest id, unless it meets a human text."""
        posts = self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/posts/batch={b}" for b in self.ours.batches()])
        keys = materialise(posts.select(self.id_col, "_name"), "post-names")
        groups = materialise(self.ours.groups().withColumnsRenamed({"name": "_name", "group": "_group"}), "stored-groups")
        # The name goes along with the lowest id: it says which text stands for the group.
        lowest = attach(keys, groups, "_name").groupBy(F.coalesce("_group", "_name").alias("_group"))
        kept = materialise(lowest.agg(F.min(F.struct(self.id_col, "_name")).alias("_first")).select("_first.*"), "kept-posts")
        human = self.theirs.table("bands").select("key").distinct()
        met = self.ours.table("bands").join(human, "key", "left_semi").select(F.col("name").alias("_name")).distinct()
        kept = kept.join(met, "_name", "left_anti").select(self.id_col)
        return posts.join(kept, self.id_col, "left_semi").drop("_name")


def curation_profile(main: DataFrame, generated: DataFrame, id_col: str, text_col: str = "tweet", label_col: str = "sentiment") -> DataFrame:
    """``(stage, measure, value)``: duplicate rows, missing cells and rows per class before and after cleaning."""
    merged = materialise(merge_generated(main, generated), "merged")
    rows = None
    for stage, df in (("merged", merged), ("cleaned", materialise(clean_main(merged, text_col, label_col, id_col), "cleaned"))):
        posts = df.drop(id_col)
        measures = [
            profile_duplicates(posts).select(F.lit("duplicate_rows").alias("measure"), F.col("duplicate_rows").alias("value")),
            profile_nulls(posts).select(F.explode(F.create_map(*[x for c in [*posts.columns, "cells"] for x in (F.lit(f"null_{c}"), F.col(f"null_{c}"))])).alias("measure", "value")),
            class_counts(posts, label_col).select(F.concat(F.lit("rows_of_"), F.col(label_col).cast("string")).alias("measure"), F.col("n_rows").alias("value")),
        ]
        for measure in measures:
            own = measure.select(F.lit(stage).alias("stage"), "measure", "value")
            rows = own if rows is None else rows.unionByName(own)
    return rows
