"""Prompts for a text generator, and cleaning of what it returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions import fixed, responses, text as tx
from postmill.functions.bind import with_once
from postmill.functions.labels import decode_labels
from postmill.operators.sampling import sample_per_class
from postmill.sources.files import split_accepted_rejected
from postmill.sources.scratch import materialise


def few_shot_prompts(
    df: DataFrame,
    id_col: str,
    text_col: str = "text",
    label_col: str = "label",
    n: int = fixed.EXAMPLES_PER_PROMPT,
    requests: int = fixed.REQUESTS_PER_CLASS,
    seed: int = 0,
    vocab: dict[str, int] = fixed.PROMPT_CODES,
) -> DataFrame:
    """``(label, request, n_examples, prompt)``: one prompt per class and request.

    The sample is drawn over ids and labels; texts are then looked up for the few drawn ids only. A class with
    fewer than ``n`` posts gives a shorter prompt, which ``n_examples`` shows.
    """
    drawn = sample_per_class(df.where(F.col(label_col).isin(list(vocab.values()))), id_col, label_col, n, requests, seed)
    texts = df.select(id_col, F.col(text_col).alias("_text"))
    # At most classes * requests * n drawn rows: written, so that their size decides how they are joined.
    picked = texts.join(materialise(drawn, "drawn"), id_col)
    quoted = F.regexp_extract(F.to_json(F.array("_text")), r"(?s)\A\[(.*)\]\z", 1)
    line = F.concat(F.lit('  "'), F.col("position").cast("string"), F.lit('": '), quoted)
    grouped = picked.groupBy(F.col(label_col).alias("label"), "request").agg(
        F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("lines")
    )
    examples = F.concat(F.lit("{\n"), F.array_join(F.transform("lines", lambda x: x["line"]), ",\n"), F.lit("\n}"))
    before, after = fixed.PROMPT_OPENING.split("{}")
    opening = F.concat(F.lit(before), F.upper(decode_labels("label", vocab)), F.lit(after))
    return grouped.select(
        "label",
        "request",
        F.size("lines").alias("n_examples"),
        F.concat_ws("\n", opening, examples, F.lit(fixed.PROMPT_CLOSING)).alias("prompt"),
    )


def with_verdict(df: DataFrame, text_col: str = "text", strict_emoji: bool = False) -> DataFrame:
    """Add ``cleaned`` and ``reject_reason``; exactly one of the two is NULL."""
    judged = with_once(df, "_verdict", tx.verdict(text_col, strict_emoji))
    return judged.select(*df.columns, "_verdict.cleaned", "_verdict.reject_reason")


def clean_generated(df: DataFrame, text_col: str = "text", strict_emoji: bool = False) -> DataFrame:
    """Usable posts with their text cleaned; the others are left out."""
    kept = with_verdict(df, text_col, strict_emoji).where(F.col("reject_reason").isNull())
    return kept.withColumn(text_col, F.col("cleaned")).drop("cleaned", "reject_reason")


def parse_posts(df: DataFrame, generated_col: str = "generated") -> DataFrame:
    """Add ``posts``: the usable posts of a generated text as ``(position, post)`` records, in order.

    The posts of a response are judged as an array on their row, so a response needs no shuffle to come back
    together.
    """
    judged = F.transform(
        responses.response_values(generated_col),
        lambda v, i: F.struct(i.alias("position"), tx.verdict(v).alias("verdict")),
    )
    usable = F.filter(judged, lambda p: p["verdict"]["reject_reason"].isNull())
    posts = F.transform(usable, lambda p: F.struct(p["position"].alias("position"), p["verdict"]["cleaned"].alias("post")))
    return with_once(df, "posts", posts)


def parse_responses(df: DataFrame, body_col: str = "body") -> DataFrame:
    """Add ``generated``, the text inside the response, and ``posts``, the usable posts inside that text."""
    return parse_posts(df.withColumn("generated", responses.extract_response_text(body_col)), "generated")


def accepted_and_failed(parsed: DataFrame, body_col: str = "body", keep: tuple[str, ...] = ("label",)) -> tuple[DataFrame, DataFrame]:
    """Split parsed responses into accepted posts, one row each, and failed generations.

    A response without a usable post fails as a whole, with its generated text; a body from which no text can
    be dug fails with the body itself, so every response is in exactly one of the two.
    """
    good, bad = split_accepted_rejected(parsed, F.size("posts") > 0)
    accepted = good.withColumn("_post", F.explode("posts")).select(
        *keep, F.col("_post.position").alias("position"), F.col("_post.post").alias("tweet")
    )
    reason = F.when(F.col("generated").isNull(), "no_text").otherwise("no_posts")
    failed = bad.select(*keep, F.coalesce("generated", body_col).alias("generated"), reason.alias("reason"))
    return accepted, failed
