"""A stored index of MinHash bands and near-duplicate groups that grows by batches.

A text is known by a hash of it. A batch signs only texts that no earlier batch has signed, looks for the stored texts that
share its bands, and appends what it found: its bands, the group of every text that has one by now, and which earlier
groups became one. Nothing stored is rewritten, and no stored text is read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import fixed
from postmill.operators import minhash
from postmill.operators.components import connected_components
from postmill.operators.neardup import bucket_edges
from postmill.sources.scratch import hadoop_fs, materialise

SCHEMAS = {
    "bands": "name binary, key binary",  # of every text signed
    "labels": "name binary, label binary",  # group of a text when it first had one
    "merges": "label binary, into binary",  # groups that a batch joined
}


def text_name(text: str) -> Column:
    """Sixteen bytes of a text's SHA-256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


class BandIndex:
    """The index under ``path``, a folder all executors share.

    Batches have numbers in ascending order. A batch counts once all its parts are written; adding it again, say after a
    failure, replaces it.
    """

    def __init__(self, spark: SparkSession, path: str, threshold: float = fixed.THRESHOLD, num_perm: int = fixed.NUM_PERM) -> None:
        self.spark, self.path, self.num_perm = spark, path.rstrip("/"), num_perm
        self.bands, self.rows = minhash.best_bands(threshold, num_perm)

    def batches(self) -> list[int]:
        fs, folder = hadoop_fs(self.spark, f"{self.path}/done")
        return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def table(self, part: str, before: int | None = None) -> DataFrame:
        """What the finished batches have written of ``bands``, ``labels`` or ``merges``."""
        paths = [f"{self.path}/{part}/batch={b}" for b in self.batches() if before is None or b < before]
        schema = SCHEMAS[part]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, part: str, batch: int) -> DataFrame:
        path = f"{self.path}/{part}/batch={batch}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def groups(self, before: int | None = None) -> DataFrame:
        """``(name, group)`` of every text that collides with another."""
        labels, merges = self.table("labels", before), self.table("merges", before)
        into = connected_components(merges, "label", "into").select(F.col("id").alias("label"), "component")
        return labels.join(into, "label", "left").select("name", F.coalesce("component", "label").alias("group"))

    def add(self, texts: DataFrame, batch: int, text_col: str = "text", name_col: str | None = None) -> int:
        """Add the texts of a batch and return how many were signed. NULL texts are left out, repeated ones count once.

        ``name_col`` holds their ``text_name``, if that is stored already.
        """
        if any(b > batch for b in self.batches()):
            raise ValueError(f"batch {batch} comes before a finished one")
        name = F.col(name_col) if name_col else text_name(text_col)
        named = texts.where(F.col(text_col).isNotNull()).select(name.alias("name"), F.col(text_col).alias("text"))
        stored = self.table("bands", batch)
        fresh = named.dropDuplicates(["name"]).join(stored.select("name").distinct(), "name", "left_anti")
        signed = minhash.band_keys(fresh, "name", self.bands, self.rows, "text", self.num_perm)
        bands = self._write(signed.select(F.col("id").alias("name"), "key"), "bands", batch)
        # One stored text stands for a bucket, under the group it is in.
        own = bands.select("key").distinct()
        met = materialise(stored.join(own, "key", "left_semi").groupBy("key").agg(F.min("name").alias("leader")), "met-buckets")
        old = self.groups(batch).withColumnsRenamed({"name": "leader", "group": "_group"})
        met = materialise(met.join(old, "leader", "left").select("key", "leader", F.coalesce("_group", "leader").alias("label")), "met-groups")
        across = bands.join(met, "key").select(F.col("name").alias("a"), F.col("label").alias("b"))
        inside = bucket_edges(bands.withColumnRenamed("name", "id"))
        components = connected_components(materialise(across.unionByName(inside).distinct(), "batch-edges"))
        components = materialise(components.select(F.col("id").alias("name"), F.col("component").alias("label")), "batch-groups")
        # A stored text that was alone until now gets its first label, like the new ones.
        alone = met.where("leader = label").select(F.col("leader").alias("name")).distinct().join(self.table("labels", batch), "name", "left_anti")
        new = components.join(bands.select("name").distinct().unionByName(alone), "name", "left_semi")
        self._write(new, "labels", batch)
        merged = components.where("name <> label").join(met.select(F.col("label").alias("name")).distinct(), "name", "left_semi")
        self._write(merged.select(F.col("name").alias("label"), F.col("label").alias("into")), "merges", batch)
        signed_texts = bands.select("name").distinct().count()
        fs, done = hadoop_fs(self.spark, f"{self.path}/done/batch={batch}")
        fs.mkdirs(done)
        return signed_texts
