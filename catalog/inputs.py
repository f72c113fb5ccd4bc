"""The given tables in the shapes the operators expect, in Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import text as tx
from postmill.operators.encode import SPECIAL
from postmill.operators.sampling import rank_in_class
from postmill.sources.scratch import materialise

# Sources that stand in for the human-labelled corpus; all others stand in for the synthetic one.
HUMAN_SOURCES = [f"src{i}" for i in range(10)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def all_cores(df: DataFrame) -> DataFrame:
    """Rows on all cores, for a CPU-bound step over a table too small to have a split per core. Larger ones stay."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    execution = df._jdf.queryExecution()
    small = int(execution.optimizedPlan().stats().sizeInBytes()) < cores << 20
    return df.repartition(cores, *df.columns) if small and execution.toRdd().getNumPartitions() < cores else df


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch losses; a tenth of the batches has none."""
    batches = table(spark, sf_dir, "events").groupBy("user_id").agg((F.avg("value") / 100).alias("loss"), F.count("*").alias("n"))
    return batches.withColumn("loss", F.when(F.col("user_id") % 10 != 0, F.col("loss")))


def label_code() -> Column:
    return F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 1).otherwise(0).cast("int")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", label_code().alias("label"))
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars").join(labels, "doc_id")


def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("doc_id", F.col("text").alias("tweet"), F.col("label").alias("sentiment"), "source")


def is_human() -> Column:
    return F.col("source").isin(HUMAN_SOURCES)


def main_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as posts; those without a label have a NULL sentiment."""
    labels = table(spark, sf_dir, "labels").select("doc_id", label_code().alias("sentiment"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("tweet"))
    return docs.join(labels, "doc_id", "left")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a class predicted from the length of the text; for some lengths none."""
    guess = F.when(F.col("n_chars") % 17 == 0, None).when(F.col("n_chars") > 2000, 2).when(F.col("n_chars") > 300, 1).otherwise(0)
    return labelled(spark, sf_dir).select("doc_id", "label", guess.alias("predicted"))


def raw_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn four times, dressed up the way a generator dresses posts."""
    turns = all_cores(table(spark, sf_dir, "conversations"))
    tag = F.concat(F.lit(" #"), "role")
    variants = {
        "marked": F.concat(F.lit("1. 2. "), "text", tag, tag),
        "emoji": F.concat(F.lit('- "🚀🚀🚀" '), "text"),
        "leak": F.concat("text", F.lit("\nThis is a Positive  tweet for you")),
        "meta": F.concat(F.lit("A synthetic post: "), "text"),
    }
    choices = F.explode(F.create_map(*[x for k, v in variants.items() for x in (F.lit(k), v)]))
    return turns.select("conv_id", "turn", choices.alias("variant", "text"))


def generator_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response per conversation: its turns as a JSON object; without assistant turns, an apology."""
    turns = table(spark, sf_dir, "conversations")
    posts = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"),
        F.count_if(F.col("role") == "system").alias("n_system"),
    )
    as_map = F.map_from_entries(F.transform("turns", lambda t: F.struct(t["turn"].cast("string"), t["text"])))
    generated = F.when(F.col("n_system") > 0, "Sorry, no.").otherwise(F.concat(F.lit("Here: "), F.to_json(as_map), F.lit(" {}")))
    body = F.to_json(F.struct(F.struct(F.array(F.struct(generated.alias("text"))).alias("choices")).alias("output")))
    label = F.when(F.size("turns") > 6, 2).when(F.size("turns") > 3, 1).otherwise(0)
    return posts.select("conv_id", label.alias("label"), body.alias("body"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Special tokens, and the words and characters of ``benchmark``, characters as start and as rest of a word."""
    items = table(spark, sf_dir, "benchmark").select(F.lower("text").alias("text"))
    words = items.select(F.explode(tx.words("text")).alias("token"))
    chars = items.select(F.explode(F.split("text", "")).alias("c")).where("c <> ''").distinct()
    pieces = chars.select(F.col("c").alias("token")).unionByName(chars.select(F.concat(F.lit("##"), "c").alias("token")))
    tokens = words.unionByName(pieces).distinct().where(~F.col("token").isin(SPECIAL))
    ranked = rank_in_class(materialise(tokens.select("token", F.lit(0).alias("label")), "tokens"), "token", "label", seed=0)
    numbered = ranked.select("token", (F.col("rank") + len(SPECIAL)).cast("int").alias("id"))
    special = spark.createDataFrame([(t, i) for i, t in enumerate(SPECIAL)], "token string, id int")
    return special.unionByName(numbered)


def synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring words of ``benchmark`` taken as synonyms of one another."""
    words = table(spark, sf_dir, "benchmark").select(F.split(F.lower("text"), " ", -1).alias("w"))
    pairs = F.arrays_zip(F.expr("slice(w, 1, size(w) - 1)").alias("token"), F.expr("slice(w, 2, size(w) - 1)").alias("synonym"))
    return words.select(F.explode(pairs).alias("p")).select("p.token", "p.synonym").where("token <> synonym").distinct()
