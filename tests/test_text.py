"""Golden rows for the text expressions, worked out by hand."""

import html
import random
import re
import time
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from postmill.functions import text as tx
from postmill.operators.generated import clean_generated, with_verdict


def apply(spark, expression, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [row.y for row in df.select("i", expression("x").alias("y")).orderBy("i").collect()]


def test_masks_links_before_mentions(spark):
    assert apply(spark, tx.preprocess_text, "[@Bob](https://x/y): hi @ 5") == ["[@USER hi @ 5"]


def test_masks_the_tail_of_a_mail_address(spark):
    assert apply(spark, tx.mask_mentions, "mail a@b.com now") == ["mail a@USER now"]


def test_masks_words_that_only_look_like_links(spark):
    assert apply(spark, tx.mask_urls, "httpfoo and HTTP://x http://a.b/c.") == ["[URL] and HTTP://x [URL]"]


def test_masks_end_at_exotic_spaces(spark):
    assert apply(spark, tx.mask_urls, "http://x y http://z\x1cw http://q　r") == [
        "[URL] y [URL]\x1cw [URL]　r"
    ]


def test_unescapes_entities(spark):
    texts = ["a &amp; b", "&amp;lt; &#65;&eacute;", None, "plain"]
    assert apply(spark, tx.unescape_html, *texts) == ["a & b", "&lt; Aé", None, "plain"]


def test_unescapes_as_the_standard_library(spark):
    names = [f"&{n}{end}" for n in html5 for end in ("", "x", " &", "=")]
    codes = [*range(0x110), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFD, 0xFFFE, 0x1F680, 0x1FFFF, 0x10FFFD, 0x10FFFF, 0x110000, 10**9, 10**30]
    numbers = [f"a&#{z}{c}{end}b" for c in codes for z in ("", "00") for end in (";", " ")]
    numbers += [f"&#{x}{c:X}{end}" for c in codes for x in "xX" for end in (";", "g")]
    odd = ["&", "&&", "&;", "&#;", "&#x;", "&#xg", "&a", "&notit;", "&notin;", "&ampamp;amp;", "&AMP&amp", "&\U0001f680amp;", "&" + "n" * 40 + ";", "&not" + "x" * 29 + ";", "&\tamp;", "", "&é;&eacute", "&Amp;", "&amp ;"]
    texts = names + numbers + odd
    got = apply(spark, tx.unescape_html, *texts)
    assert [(t, g) for t, g in zip(texts, got) if g != html.unescape(t)] == []


def test_masking_stays_in_the_jvm(spark):
    df = spark.range(3).select(tx.preprocess_text(F.concat(F.lit("a &amp; b"), "id"), cashtags=True).alias("t"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "Scan ExistingRDD" not in plan


def test_unescaped_space_ends_a_link(spark):
    assert apply(spark, tx.preprocess_text, "http://x&nbsp;y") == ["[URL] y"]


def test_cashtags_are_masked_on_request(spark):
    assert apply(spark, tx.mask_cashtags, "$AAPL $TOOLONG $btc $A.") == ["[TICKER] $TOOLONG $btc [TICKER]."]
    assert apply(spark, lambda c: tx.preprocess_text(c, cashtags=True), "$AAPL @x") == ["[TICKER] @USER"]


@pytest.mark.parametrize(
    "text, n, expected",
    [("one", 2, False), ("a b", 2, True), ("  a  ", 2, False), ("", 2, False), ("a b", 3, False), ("\na\tb c ", 3, True)],
)
def test_word_count(spark, text, n, expected):
    assert apply(spark, lambda c: tx.has_words(c, n), text) == [expected]


def test_word_count_of_a_huge_word_is_quick(spark):
    assert apply(spark, lambda c: tx.has_words(c, 3), "x" * 2_000_000) == [False]


def test_tokenisers_differ_on_runs_of_spaces(spark):
    assert apply(spark, tx.space_tokens, "a  b ") == [["a", "", "b", ""]]
    assert apply(spark, tx.words, " a   b\n") == [["a", "b"]]


def test_list_markers(spark):
    texts = ["1. 2. x", "11% wick", "- x", "3) y", "12:z", "a 1."]
    assert apply(spark, tx.strip_list_marker, *texts) == ["2. x", "% wick", "x", "y", "z", "a 1."]


def test_repeated_emoji(spark):
    assert apply(spark, tx.collapse_repeated_emoji, "go🚀🚀🚀📈🚀 高高 aa") == ["go🚀📈🚀 高 aa"]
    assert apply(spark, lambda c: tx.collapse_repeated_emoji(c, strict=True), "🚀🚀 高高") == ["🚀 高高"]


def test_dropped_characters(spark):
    assert apply(spark, tx.drop_chars, '1⃣ "a"') == ["1 a"]


def test_repeated_tags(spark):
    texts = ["$BTC up $BTC #go $ETH #go", "$BTCUSD $BTC x $BTC", "$a $A", "no tags", "#x\n#x"]
    expected = [" up $BTC  $ETH #go", "$BTCUSD  x $BTC", "$a $A", "no tags", "\n#x"]
    assert apply(spark, tx.dedupe_tags, *texts) == expected


def test_rejections(spark):
    cases = {
        "My TWEETS today ok": "meta_words",
        "a positive tweet": "label_leak",
        "a Neutral  tweet, said me\n": "label_leak",
        "a positive tweet\nmore of it": None,
        "a positive tweeter here": None,
        "🚀🚀": "emoji_only",
        "$BTC  #x @u ": "tags_only",
        "$BTC up": "too_short",
        "all is fine": None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "text string")
    got = {r.text: r.reject_reason for r in df.withColumn("reject_reason", tx.reject_reason("text")).collect()}
    assert got == cases


def test_many_tags_do_not_backtrack(spark):
    assert apply(spark, tx.is_tags_only, "#tag " * 5_000 + "!") == [False]


def test_cleaner(spark):
    df = spark.createDataFrame(
        [(1, '1. 2. "up 🚀🚀 $A $A now"'), (2, "synthetic data is here"), (3, None), (4, " - a b c ")], "id int, text string"
    )
    assert {r.id: r.text for r in clean_generated(df).collect()} == {1: "up 🚀  $A now", 4: "- a b c"}
    verdicts = with_verdict(df).select("id", "cleaned", "reject_reason").collect()
    assert all((r.cleaned is None) != (r.reject_reason is None) for r in verdicts)


def test_masking_is_idempotent(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    once = docs.select(tx.preprocess_text("text").alias("once"))
    twice = once.withColumn("twice", tx.mask_mentions(tx.mask_urls("once")))
    assert twice.where(F.col("once") != F.col("twice")).count() == 0


def test_tags_keep_their_last_occurrence(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["$BTC", "#go", "$BTCUSD", "#", "$", " ", "x", "é", "$é", "##go", "\n", "\\\\", "."]) for _ in range(rng.randrange(25))) for _ in range(400)]

    def want(text):
        tags = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[$#]\w+", text)]
        last = {tag: start for start, _, tag in tags}
        for start, end, tag in reversed(tags):
            if last[tag] != start:
                text = text[:start] + text[end:]
        return text

    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("out", tx.dedupe_tags("text"))
    assert all(r.out == want(r.text) for r in df.collect())


def test_many_different_tags_take_little_time(spark):
    text = " ".join(f"#t{i}" for i in range(20_000)) + " #t7"
    df = spark.createDataFrame([(text,)], "text string")
    df.select(tx.dedupe_tags("text").alias("out")).collect()
    started = time.perf_counter()
    out = df.select(tx.dedupe_tags("text").alias("out")).first().out
    assert time.perf_counter() - started < 2
    assert out == text.replace("#t7 ", " ", 1)
