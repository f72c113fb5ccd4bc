import json
import math

import pytest

from postmill.functions import labels, responses, scores
from postmill.operators.generated import accepted_and_failed, few_shot_prompts, parse_posts, parse_responses
from postmill.operators.sampling import sample_per_class


def one(spark, value, schema, expression):
    return spark.createDataFrame([(value,)], f"x {schema}").select(expression.alias("y")).first().y


def test_remap(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (None,)], "x int")
    assert [r.y for r in df.select(labels.remap_labels("x").alias("y")).collect()] == [2, 0, 1, None]
    assert one(spark, 7, "int", labels.remap_labels("x", strict=False)) is None
    with pytest.raises(Exception, match="label outside the map"):
        one(spark, 7, "int", labels.remap_labels("x"))


def test_names_and_codes(spark):
    assert one(spark, "bearish", "string", labels.encode_labels("x")) == 2
    assert one(spark, "other", "string", labels.encode_labels("x")) is None
    assert one(spark, 1, "int", labels.decode_labels("x")) == "bullish"
    assert one(spark, "BULLISH", "string", labels.harmonise_predictions("x")) == "positive"
    assert one(spark, "Neutral", "string", labels.harmonise_predictions("x")) == "neutral"


def test_scores(spark):
    assert one(spark, [1.0, 3.0, 3.0], "array<double>", scores.argmax("x")) == 1
    top = one(spark, [1000.0, 1001.0, 1001.0], "array<float>", scores.softmax_topk("x", 2))
    p = 1 / (2 + math.exp(-1))
    assert [(r.id, round(r.value, 9)) for r in top] == [(1, round(p, 9)), (2, round(p, 9))]
    records = [("BEARISH", 0.1), ("NEUTRAL", 0.2), ("BULLISH", 0.7)]
    got = one(spark, records, "array<struct<label string, score double>>", scores.scores_in_order("x"))
    assert got == [0.2, 0.7, 0.1]


def values(spark, text):
    return one(spark, text, "string", responses.response_values("x"))


def test_first_object_only(spark):
    assert values(spark, 'ok {"0":"a b c","1":"d"} {"2":"e"}') == ["a b c", "d"]
    assert values(spark, "no braces") == []
    assert values(spark, None) == []
    assert values(spark, '{"0": "cut } here"}') == ["cut "]


def test_only_strings_count(spark):
    assert values(spark, '{"0": 5, "1": null, "2": "x y z", "3": ["q"], "4": true}') == ["x y z"]


def test_last_of_a_repeated_key(spark):
    assert values(spark, '{"0": "a", "1": "b", "0": "c"}') == ["b", "c"]


def test_broken_objects(spark):
    assert values(spark, '{"0": "a \\"q\\" b", "1": "c",}') == ['a "q" b', "c"]
    assert values(spark, '{"0": "a b", "1": "c d }') == ["a b", "c d "]
    assert values(spark, "{'0': 'a b'}") == ["a b"]
    assert values(spark, "{nothing here}") == []


def test_parse_posts(spark):
    df = spark.createDataFrame(
        [(1, 'ok {"0":"a b c","1":"d"} {"2":1}'), (2, '{"0": 5, "1": null, "2": "x y z"}'), (3, "none")], "id int, generated string"
    )
    got = {r.id: [(p.position, p.post) for p in r.posts] for r in parse_posts(df).collect()}
    assert got == {1: [(0, "a b c")], 2: [(0, "x y z")], 3: []}


def response(text):
    return json.dumps({"output": {"choices": [{"text": text}]}})


def test_every_response_is_accepted_or_failed(spark):
    bodies = [(0, response('{"0": "a b c", "1": "d e f"}')), (1, response("sorry")), (2, "not json"), (1, response('{"0":"x"}'))]
    df = spark.createDataFrame(bodies, "label int, body string")
    accepted, failed = accepted_and_failed(parse_responses(df))
    assert sorted((r.label, r.position, r.tweet) for r in accepted.collect()) == [(0, 0, "a b c"), (0, 1, "d e f")]
    assert sorted((r.label, r.generated, r.reason) for r in failed.collect()) == [
        (1, "sorry", "no_posts"),
        (1, '{"0":"x"}', "no_posts"),
        (2, "not json", "no_text"),
    ]


def test_prompts(spark):
    rows = [(i, f'text "{i}"\né', i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    prompts = few_shot_prompts(df, "id", n=3, requests=2).collect()
    assert sorted((r.label, r.request, r.n_examples) for r in prompts) == [(0, 0, 3), (0, 1, 3), (1, 0, 3), (1, 1, 3)]
    texts = {t: c for _, t, c in rows}
    for row in prompts:
        name = {0: "NEUTRAL", 1: "POSITIVE"}[row.label]
        opening, body, closing = (
            f"Create synthetic {name} tweets about the financial market or crypto currencies. Examples:\n",
            None,
            "\nDo not explain your answer. Only answer according to the shown valid JSON format.",
        )
        assert row.prompt.startswith(opening) and row.prompt.endswith(closing)
        body = row.prompt[len(opening) : -len(closing)]
        examples = json.loads(body)
        assert list(examples) == ["0", "1", "2"] and len(set(examples.values())) == 3
        assert all(texts[t] == row.label for t in examples.values())
        assert body == json.dumps(examples, indent=2, ensure_ascii=False)


def test_short_class_gives_a_short_prompt(spark):
    df = spark.createDataFrame([(1, "a b", 2)], "id long, text string, label int")
    rows = few_shot_prompts(df, "id", requests=1).collect()
    assert [(r.label, r.n_examples) for r in rows] == [(2, 1)]


@pytest.mark.parametrize(
    "text,posts",
    [
        ("{'0': 'a b c', '1': 'it\\'s d e',}", ["a b c", "it's d e"]),
        ("{'0': 'it's a b', '1': 'c d e',}", ["it's a b", "c d e"]),
        ('{0: "a b c", 1: "d \\"e\\" f"}', ["a b c", 'd "e" f']),
        ('{"0": "a b c" "1": "d e f"}', ["a b c", "d e f"]),
        ('{"0": "a b c}', ["a b c"]),
    ],
)
def test_repair_of_broken_objects(spark, text, posts):
    assert one(spark, text, "string", responses.response_values("x")) == posts


def test_tokens_of_the_top_ids(spark):
    vocab = spark.createDataFrame([("a", 0), ("b", 1)], "token string, id int")
    hits = spark.createDataFrame([(1,), (5,)], "id int")
    assert sorted((r.id, r.token) for r in scores.token_of(vocab, hits).collect()) == [(1, "b"), (5, None)]


def test_many_requests_need_no_list_on_the_driver(spark):
    df = spark.createDataFrame([(i, i % 2, "t") for i in range(9)], "id long, label int, text string")
    drawn = sample_per_class(df, "id", n=3, requests=20_000)
    counts = drawn.groupBy("label", "request").count().groupBy("count").count().collect()
    assert [tuple(r) for r in counts] == [(3, 40_000)]
