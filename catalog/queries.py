"""One query per operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import inputs as src
from postmill.functions import fixed, labels as lb, scores, text as tx
from postmill.operators import corpus, encode, generated, metrics, models, neardup, sampling, synonyms
from postmill.plans import curation, evaluation, preparation
from postmill.sources import files, versions
from postmill.operators.components import connected_components
from postmill.sources.scratch import materialise, scratch_path
from postmill.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def _documents(spark, d):
    return src.table(spark, d, "documents")


# Sources and sinks.


@query
def convert_format(spark, d):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    csv, parquet = scratch_path(spark, "csv"), scratch_path(spark, "parquet")
    files.write_posts(_documents(spark, d), csv, format="csv")
    return files.convert_format(spark, csv, parquet, schema)


@query
def read_splits(spark, d):
    path = scratch_path(spark, "splits")
    split = F.when(src.is_human(), "human").otherwise("synthetic")
    files.write_splits(_documents(spark, d).select("doc_id", "text", split.alias("split"), "source"), path)
    return files.read_splits(spark, path, "human").select("doc_id", "split", "source", F.length("text").alias("n"))


@query
def replace_table_versions(spark, d):
    """The first version of a table and the second, made from the first."""
    table = versions.VersionedTable(spark, scratch_path(spark, "versioned"))
    first = table.write(src.main_table(spark, d))
    table.write(corpus.clean_main(table.read(first), id_col="doc_id"), after=first)
    every = [table.read(v).select(F.lit(v).alias("version"), "doc_id", "sentiment") for v in table.versions()]
    return every[0].unionByName(every[1])


@query
def replace_table(spark, d):
    path = scratch_path(spark, "main")
    files.write_posts(src.main_table(spark, d).where("doc_id % 2 = 0"), path)
    files.replace_table(src.main_table(spark, d), path)
    kept = files.replace_table(corpus.clean_main(spark.read.parquet(path), id_col="doc_id"), path)
    new, old = spark.read.parquet(path), spark.read.parquet(kept)
    return new.select(F.lit("new").alias("version"), "doc_id").unionByName(old.select(F.lit("old").alias("version"), "doc_id"))


@query
def split_accepted_rejected(spark, d):
    verdicts = generated.with_verdict(src.raw_posts(spark, d))
    good, bad = files.write_accepted_rejected(verdicts, F.col("reject_reason").isNull(), scratch_path(spark, "sides"), format="csv")
    keys = ["conv_id", "turn", "variant"]
    return good.select(*keys, F.lit("accepted").alias("side")).unionByName(bad.select(*keys, F.lit("rejected").alias("side")))


# Columns and filters.


@query
def project_text_label(spark, d):
    posts = corpus.rename_columns(src.tweets(spark, d))
    return corpus.project_text_label(posts, ["doc_id"])


@query
def remap_labels(spark, d):
    return src.labelled(spark, d).select("doc_id", lb.remap_labels("label").alias("label"))


@query
def encode_labels(spark, d):
    return src.labelled(spark, d).select("doc_id", lb.encode_labels(lb.decode_labels("label")).alias("label"))


@query
def decode_labels(spark, d):
    return src.labelled(spark, d).select("doc_id", lb.decode_labels("label").alias("label"))


@query
def harmonise_predictions(spark, d):
    names = src.predictions(spark, d).select("doc_id", F.upper(lb.decode_labels("predicted")).alias("name"))
    return names.select("doc_id", lb.harmonise_predictions("name").alias("label"))


@query
def drop_missing(spark, d):
    return corpus.drop_missing(src.main_table(spark, d), ["tweet", "sentiment"]).select("doc_id", "sentiment")


@query
def text_as_string(spark, d):
    """Texts that are numbers, and missing ones."""
    rows = src.main_table(spark, d).select("doc_id", F.col("sentiment").alias("text"))
    return corpus.text_as_string(rows)


@query
def min_words(spark, d):
    return corpus.min_words(_documents(spark, d), 3).select("doc_id")


@query
def of_class(spark, d):
    return corpus.of_class(src.labelled(spark, d), 2).select("doc_id", "label")


@query
def drop_ids(spark, d):
    return corpus.drop_ids(_documents(spark, d), src.table(spark, d, "labels"), "doc_id").select("doc_id", "lang")


@query
def head(spark, d):
    return corpus.head(_documents(spark, d), 100, "doc_id").select("doc_id", "lang")


@query
def keep_first(spark, d):
    return corpus.keep_first(_documents(spark, d), "text", "doc_id").select("doc_id", "source")


# Text.


@query
def unescape_html(spark, d):
    return src.table(spark, d, "pages").select("page_id", tx.unescape_html("html").alias("html"))


@query
def mask_text(spark, d):
    docs = _documents(spark, d).select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "text")
    pages = src.table(spark, d, "pages").select(F.lit("url").alias("kind"), F.col("page_id").alias("id"), F.concat(F.lit("see ["), "url", F.lit("] @me")).alias("text"))
    names = src.table(spark, d, "customer").select(F.lit("name").alias("kind"), F.col("c_custkey").alias("id"), F.concat(F.lit("@"), "c_name", F.lit(" hi")).alias("text"))
    every = docs.unionByName(pages).unionByName(names)
    return every.select("kind", "id", tx.preprocess_text("text").alias("masked"))


@query
def mask_cashtags(spark, d):
    tagged = F.concat(F.lit("$"), F.substring("c_mktsegment", 1, 5), F.lit(" $"), "c_mktsegment")
    return src.table(spark, d, "customer").select("c_custkey", tx.mask_cashtags(tagged).alias("masked"))


@query
def tokenise(spark, d):
    docs = _documents(spark, d)
    return docs.select("doc_id", F.size(tx.space_tokens("text")).alias("n_space"), F.size(tx.words("text")).alias("n_words"))


@query
def clean_generated(spark, d):
    return generated.clean_generated(src.raw_posts(spark, d))


@query
def reject_reasons(spark, d):
    return generated.with_verdict(src.raw_posts(spark, d)).select("conv_id", "turn", "variant", "reject_reason")


# Responses and prompts.


@query
def parse_posts(spark, d):
    accepted, _ = generated.accepted_and_failed(generated.parse_responses(src.generator_responses(spark, d)), keep=("conv_id", "label"))
    return accepted


@query
def failed_generations(spark, d):
    _, failed = generated.accepted_and_failed(generated.parse_responses(src.generator_responses(spark, d)), keep=("conv_id", "label"))
    return failed


@query
def ingest_responses(spark, d):
    landing, accepted = scratch_path(spark, "landing"), scratch_path(spark, "accepted")
    failed, state = scratch_path(spark, "failed"), scratch_path(spark, "stream")
    src.generator_responses(spark, d).select("label", "body").write.json(landing)
    cut = F.substring(F.to_json(F.struct("label", "body")), 1, 30)
    src.generator_responses(spark, d).where("conv_id % 50 = 7").select(cut.alias("value")).write.mode("append").text(landing)
    ingest.ingest_responses(spark, landing, accepted, failed, state, available_now=True).awaitTermination()
    good = ingest.read_accepted(spark, accepted).select(F.lit("accepted").alias("side"), "label", F.col("tweet").alias("text"))
    bad = ingest.read_failed(spark, failed).select(F.lit("failed").alias("side"), "label", F.col("generated").alias("text"))
    return good.unionByName(bad)


@query
def sample_per_class(spark, d):
    return sampling.sample_per_class(src.labelled(spark, d), "doc_id", requests=2)


@query
def few_shot_prompts(spark, d):
    return generated.few_shot_prompts(src.labelled(spark, d), "doc_id")


# Class scores.


@query
def argmax_label(spark, d):
    return src.table(spark, d, "embeddings").select("vec_id", scores.argmax("embedding").alias("predicted"))


@query
def softmax_topk(spark, d):
    top = src.table(spark, d, "embeddings").select("vec_id", F.posexplode(scores.softmax_topk("embedding", 5)).alias("place", "hit"))
    return top.select("vec_id", "place", F.col("hit.id").alias("id"), F.round("hit.value", 8).alias("probability"))


@query
def scores_in_order(spark, d):
    value = F.col("embedding").cast("array<double>")
    records = F.array(*[F.struct(F.lit(n).alias("label"), value[i].alias("score")) for i, n in enumerate(["BEARISH", "NEUTRAL", "BULLISH"])])
    ordered = src.table(spark, d, "embeddings").select("vec_id", scores.scores_in_order(records).alias("s"))
    return ordered.select("vec_id", *[F.round(F.col("s")[i], 6).alias(n.lower()) for i, n in enumerate(fixed.SCORE_LABELS)])


# Profiles and metrics.


@query
def class_counts(spark, d):
    return metrics.class_counts(src.labelled(spark, d))


@query
def largest_class(spark, d):
    return metrics.largest_class(src.labelled(spark, d))


@query
def profile_duplicates(spark, d):
    return metrics.profile_duplicates(src.main_table(spark, d).drop("doc_id"))


@query
def duplicate_rows(spark, d):
    return metrics.duplicate_rows(src.main_table(spark, d).drop("doc_id"))


@query
def profile_nulls(spark, d):
    return metrics.profile_nulls(src.main_table(spark, d))


@query
def accuracy(spark, d):
    scored = metrics.accuracy(src.predictions(spark, d), "label", "predicted")
    return scored.select(F.round("accuracy", 9).alias("accuracy"))


@query
def class_scores(spark, d):
    table = metrics.class_scores(metrics.confusion_counts(src.predictions(spark, d), "label", "predicted"))
    return table.select("label", "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query
def weighted_f1(spark, d):
    scored = metrics.weighted_f1(src.predictions(spark, d), "label", "predicted")
    return scored.select(F.round("weighted_f1", 9).alias("weighted_f1"))


@query
def confusion_matrix(spark, d):
    matrix = metrics.confusion_matrix(src.predictions(spark, d), "label", "predicted")
    return matrix.select(F.col("true").alias("label"), *[F.col(c).alias(f"predicted_{c}") for c in matrix.columns[1:]])


@query
def perplexity(spark, d):
    return metrics.perplexity(src.losses(spark, d)).select(F.round("perplexity", 6).alias("perplexity"))


@query
def evaluate_test(spark, d):
    scored = src.predictions(spark, d).select(
        F.when(F.col("label") == 1, "positive").when(F.col("label") == 2, "negative").otherwise("neutral").alias("label"),
        F.upper(lb.decode_labels("predicted")).alias("predicted"),
    )
    report, _ = evaluation.evaluate(scored, "test")
    return report.select("metric", F.round("value", 9).alias("value"))


@query
def evaluate_finetune_report(spark, d):
    scored = src.predictions(spark, d).withColumn("predicted", F.upper(lb.decode_labels("predicted")))
    report, _ = evaluation.evaluate(scored, "finetune", losses=src.losses(spark, d))
    return report.select("metric", F.round("value", 6).alias("value"))


@query
def evaluate_finetune(spark, d):
    scored = src.predictions(spark, d).withColumn("predicted", F.upper(lb.decode_labels("predicted")))
    _, matrix = evaluation.evaluate(scored, "finetune")
    return matrix.select(F.col("true").alias("label"), *[F.col(c).alias(f"predicted_{c}") for c in matrix.columns[1:]])


# Unions and distinct rows.


@query
def concat_splits(spark, d):
    docs = _documents(spark, d).select("doc_id", "lang", "source")
    parts = {"train": docs.where(src.is_human()), "test": docs.where(~src.is_human())}
    return corpus.concat_splits(parts)


@query
def combine_corpora(spark, d):
    items = src.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    docs = _documents(spark, d).select(F.col("doc_id").alias("id"), "text")
    return corpus.combine_corpora({"documents": docs, "benchmark": items})


@query
def merge_generated(spark, d):
    posts = src.tweets(spark, d)
    new = posts.where(~src.is_human()).select("tweet", lb.decode_labels("sentiment").alias("sentiment"))
    return corpus.merge_generated(posts.where(src.is_human()), new)


@query
def drop_exact_rows(spark, d):
    return corpus.drop_exact_rows(src.main_table(spark, d), "doc_id").select("doc_id", "sentiment")


@query
def clean_main(spark, d):
    return corpus.clean_main(src.main_table(spark, d).drop("doc_id"))


# Splits and balance.


@query
def train_val_split(spark, d):
    return sampling.train_val_split(_documents(spark, d).select("doc_id", "lang"), 0.1, "doc_id")


@query
def kfold(spark, d):
    return sampling.kfold(_documents(spark, d).select("doc_id", "lang"), "doc_id", 7)


@query
def oversample(spark, d):
    return sampling.oversample(src.labelled(spark, d), "doc_id").select("doc_id", "label", "copy")


@query
def synonym_oversample(spark, d):
    balanced = synonyms.synonym_oversample(src.labelled(spark, d), src.synonyms(spark, d), "doc_id")
    return balanced.select("doc_id", "label", "copy", "text")


# Near duplicates.


@query
def minhash_signature(spark, d):
    from postmill.operators.minhash import minhash_signature as sign

    signed = sign(_documents(spark, d).select("doc_id", "text"))
    return signed.select("doc_id", F.md5(F.array_join(F.col("signature").cast("array<string>"), ",")).alias("signature"))


@query
def near_duplicate_pairs(spark, d):
    """The links, as the groups they hold together; every link is an edge of the brute-force graph."""
    pairs = materialise(neardup.near_duplicate_pairs(_documents(spark, d), "doc_id"), "pairs")
    groups = connected_components(pairs, "id", "leader").select("id", F.col("component").alias("group_id"))
    return groups.withColumn("all_similar", F.lit(pairs.where(F.col("jaccard") < fixed.THRESHOLD).isEmpty()))


@query
def near_duplicate_groups(spark, d):
    return neardup.near_duplicate_groups(_documents(spark, d), "doc_id")


@query
def near_duplicate_groups_verified(spark, d):
    return neardup.near_duplicate_groups(_documents(spark, d), "doc_id", verify=True)


@query
def near_duplicate_star_groups(spark, d):
    return neardup.near_duplicate_groups(_documents(spark, d), "doc_id", grouping="star")


@query
def near_duplicate_star_groups_hashed(spark, d):
    return neardup.near_duplicate_groups(_documents(spark, d), "doc_id", grouping="star", order="hash")


@query
def near_duplicate_report(spark, d):
    docs = _documents(spark, d)
    return neardup.group_report(neardup.near_duplicate_groups(docs, "doc_id"), docs, "doc_id")


@query
def remove_near_duplicates(spark, d):
    return neardup.remove_near_duplicates(_documents(spark, d), "doc_id").select("doc_id", "source")


@query
def remove_overlap(spark, d):
    docs = _documents(spark, d)
    return neardup.remove_overlap(docs.where(~src.is_human()), docs.where(src.is_human()), "doc_id").select("doc_id", "source")


@query
def remove_overlap_internal(spark, d):
    docs = _documents(spark, d)
    kept = neardup.remove_overlap(docs.where(~src.is_human()), docs.where(src.is_human()), "doc_id", drop_internal=True)
    return kept.select("doc_id", "source")


# Plans.


@query
def normalise_corpus(spark, d):
    return preparation.normalise_corpus(_documents(spark, d), "doc_id", keep=["lang"])


@query
def prepare_pretraining(spark, d):
    return preparation.prepare_pretraining(_documents(spark, d), "doc_id")


@query
def prepare_general_sentiment(spark, d):
    rows = src.labelled(spark, d).select("doc_id", "text", "label", "source")
    return preparation.prepare_general_sentiment({"train": rows.where(src.is_human()), "test": rows.where(~src.is_human())}, "doc_id")


@query
def prepare_finetuning(spark, d):
    return preparation.prepare_finetuning(src.tweets(spark, d), "doc_id")


@query
def prepare_synthetic(spark, d):
    return preparation.prepare_synthetic(src.tweets(spark, d), "doc_id")


@query
def pretraining_folds(spark, d):
    return preparation.pretraining_folds(_documents(spark, d), "doc_id").select("doc_id", "fold")


@query
def build_training_set(spark, d):
    posts = src.tweets(spark, d)
    balanced, _ = preparation.build_training_set(posts.where(~src.is_human()), posts.where(src.is_human()), "doc_id")
    return balanced.select("row_id", "label", "copy", "text")


@query
def build_training_set_synonym(spark, d):
    posts = src.tweets(spark, d)
    balanced, _ = preparation.build_training_set(
        posts.where(~src.is_human()), posts.where(src.is_human()), "doc_id", mode="synonym", synonyms=src.synonyms(spark, d)
    )
    return balanced.select("row_id", "label", "copy", "text")


@query
def training_set_validation(spark, d):
    posts = src.tweets(spark, d)
    _, validation = preparation.build_training_set(posts.where(~src.is_human()), posts.where(src.is_human()), "doc_id", mode=None)
    return validation


@query
def held_out_for_perplexity(spark, d):
    return preparation.held_out_for_perplexity(src.tweets(spark, d), "doc_id")


@query
def curate_synthetic(spark, d):
    posts = src.tweets(spark, d)
    human = posts.where(src.is_human()).select("doc_id", "tweet")
    made = posts.where(~src.is_human()).select("doc_id", "tweet", "sentiment")
    main, new = made.where("sentiment = 1"), made.where("sentiment <> 1").withColumn("sentiment", lb.decode_labels("sentiment"))
    return curation.curate_synthetic(main, new, human, "doc_id").select("doc_id", "sentiment")


@query
def curate_incremental(spark, d):
    """The same posts in three batches and the human texts in two, one of them late."""
    posts = materialise(src.tweets(spark, d), "tweets")
    human = posts.where(src.is_human()).select("doc_id", "tweet")
    made = posts.where(~src.is_human()).select("doc_id", "tweet", "sentiment").withColumn("sentiment", lb.decode_labels("sentiment"))
    kept = curation.Curation(spark, scratch_path(spark, "curation"), "doc_id")
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    for batch in range(3):
        kept.add_posts(made.where(turn == batch), batch)
        if batch:
            kept.add_human(human.where(turn % 2 == batch % 2), batch)
    return kept.result().select("doc_id", "sentiment")


@query
def curation_profile(spark, d):
    made = src.tweets(spark, d).where(~src.is_human()).select("doc_id", "tweet", "sentiment")
    new = made.where("sentiment <> 1").select("doc_id", F.when(F.length("tweet") % 5 != 0, F.col("tweet")).alias("tweet"), lb.decode_labels("sentiment").alias("sentiment"))
    return curation.curation_profile(made.where("sentiment = 1"), new, "doc_id")


# Encoding, scoring, models.


def _encoded(spark, d):
    docs = src.all_cores(_documents(spark, d).select("doc_id", "text"))
    return encode.encode_corpus(docs, src.vocabulary(spark, d), "doc_id")


@query
def encode_corpus(spark, d):
    columns = corpus.training_columns(_encoded(spark, d).withColumn("label", F.col("doc_id")), "finetune")
    return columns.select(
        F.col("label").alias("doc_id"),
        F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("input_ids"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_used"),
        F.size("token_type_ids").alias("n_ids"),
    )


@query
def training_columns_pretrain(spark, d):
    columns = corpus.training_columns(_encoded(spark, d), "pretrain")
    numbers = F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, x: a + x)
    return columns.select(F.size("input_ids").alias("n_ids"), numbers.alias("sum_ids"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_used"))


@query
def mlm_mask(spark, d):
    tokens = _encoded(spark, d).select("doc_id", "input_ids")
    masked = encode.mlm_mask(tokens, "doc_id", vocab_size=1000, mask_id=encode.SPECIAL.index(encode.MASK), special_ids=list(range(len(encode.SPECIAL))))
    return masked.select("doc_id", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("input_ids", "labels")])


@query
def score_corpus(spark, d):
    def make_predictor():
        def predict(texts):
            votes = [(t.count("e"), t.count("n")) for t in texts]
            return [("BULLISH" if e > n else "BEARISH", (max(e, n) + 1) / (e + n + 1)) for e, n in votes]

        return predict

    scored = models.score_corpus(_documents(spark, d).select("doc_id", "text"), make_predictor)
    return scored.select("doc_id", F.col("prediction.label").alias("label"), F.round("prediction.score", 9).alias("score"))


def _sides(spark, d):
    """The training set, unbalanced and some of its posts without a text, and the validation posts."""
    posts = src.tweets(spark, d)
    train, validation = preparation.build_training_set(posts.where(~src.is_human()), posts.where(src.is_human()), "doc_id", mode=None)
    train = train.withColumn("text", F.when(F.length("text") % 50 != 0, F.col("text")))
    return materialise(train.select("text", "label"), "train"), materialise(validation.select("text", "label"), "validation")


def _measured(predicted):
    """Predictions of all rows, in known classes only, and no fewer hits than guessing among three has on average."""
    return predicted.agg(
        F.count("predicted").alias("n_predicted"),
        F.bool_and(F.col("predicted").isin(0, 1, 2)).alias("known_classes"),
        (3 * F.count_if(F.col("label") == F.col("predicted")) >= F.count("*")).alias("holds_up"),
    )


@query
def fit_sentiment_baseline(spark, d):
    """The baseline on validation rows, which it has not seen."""
    train, validation = _sides(spark, d)
    model = models.fit_sentiment_baseline(train, features=1 << 12, max_iter=10)
    return _measured(materialise(models.predict_baseline(model, validation).select("label", "predicted"), "predicted"))


@query
def choose_baseline(spark, d):
    """The best of three on validation rows; one of them is regularised until it knows the largest class only."""
    train, validation = _sides(spark, d)
    grid = [{"features": 1 << 10, "max_iter": 5, "regularisation": 100.0}, {"features": 1 << 12, "max_iter": 10}, {"features": 1 << 12, "max_iter": 10, "regularisation": 0.1}]
    chosen = models.choose_baseline(train, validation, grid, scratch_path(spark, "candidates"))
    predicted = materialise(models.predict_baseline(chosen.model, validation).select("label", "predicted"), "predicted")
    share = metrics.accuracy(predicted, "label", "predicted").first().accuracy
    best = abs(share - max(chosen.accuracies)) < 1e-12 and chosen.candidate == grid[chosen.accuracies.index(max(chosen.accuracies))]
    return _measured(predicted).withColumns({"n_candidates": F.lit(len(chosen.accuracies)), "is_best": F.lit(best)})
