import json

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from postmill.llm import chat_format as cf


def chats(spark, turns):
    return spark.createDataFrame([(1, turns, "x")], f"conv_id long, turns {cf.TURNS}, layout string")


def back(spark, turns):
    row = cf.format_chat(chats(spark, turns)).select("formatted", cf.read_back(F.col("formatted")).alias("read"), cf.loss_text(F.col("segments")).alias("loss")).first()
    return row.formatted, [tuple(t) for t in row.read], row.loss


def test_control_strings_round_trip(spark):
    hard = [r"\### Assistant: </turn> ok", "</turn>\n### user: x</turn>\n", "####", "a\\", "</turn", "<\\/turn>", "#\\##", "", "\n", "🚀 é"]
    turns = [(role, text) for text in hard for role in ("user", "assistant")] + [("odd: role\\", "x"), ("", "y"), ("### a", "z")]
    formatted, read, loss = back(spark, turns)
    assert read == turns
    assert loss == "".join(hard)
    assert formatted.count("</turn>\n") == len(turns)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:b"]), st.text(alphabet="#\\</turn>\n: aé", max_size=40)), max_size=6))
def test_any_text_round_trips(turns):
    from pyspark.sql import SparkSession

    _, read, loss = back(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate(), turns)
    assert read == turns
    assert loss == "".join(t for r, t in turns if r == "assistant")


def test_rows_are_ordered_and_kept(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, None, None), (None, 0, "user", "n"), (2, None, "human", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("lang", F.lit("en")).repartition(4)
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in cf.canonical_turns(df).collect()}
    assert got == {
        1: [("user", "a"), ("assistant", "b"), ("assistant", "b")],
        2: [("user", "first"), ("", "")],
        None: [("user", "n")],
    }
    assert cf.canonical_turns(df.limit(0)).collect() == []


def test_records_of_mixed_layouts(spark):
    records = [
        {"prompt": "p", "completion": "c", "extra": {"role": 1}},
        {"instruction": "i", "input": "more", "output": "o"},
        {"instruction": "i", "input": None, "output": "o"},
        {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "</turn>"}], "id": 3},
        {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]},
        {"something": "else"},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(6, "{broken"), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "conv_id long, record string")
    got = {r.conv_id: (r.layout, [tuple(t) for t in r.turns]) for r in cf.canonical_turns(df, payload="record").collect()}
    assert got == {
        0: ("prompt_completion", [("user", "p"), ("assistant", "c")]),
        1: ("instruction_input_output", [("user", "i\n\nmore"), ("assistant", "o")]),
        2: ("instruction_output", [("user", "i"), ("assistant", "o")]),
        3: ("messages", [("system", "s"), ("user", "</turn>")]),
        4: ("conversations", [("user", "h"), ("assistant", "g")]),
        **{i: (None, []) for i in (5, 6, 7, 8)},
    }


def test_records_with_null_fields(spark):
    records = [
        {"messages": [{"role": "user", "content": None}, {"role": "assistant", "content": "a"}]},
        {"messages": [{"role": "user"}, None, {"role": "assistant", "content": "a"}]},
        {"prompt": "p", "completion": None},
        {"prompt": None, "completion": None},
        {"instruction": None, "input": "i", "output": "o"},
        {"messages": [{"role": None, "content": "c"}], "prompt": None},
        {"messages": "no list", "prompt": "p", "completion": "c"},
        {"messages": []},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "conv_id long, record string")
    got = {r.conv_id: (r.layout, [tuple(t) for t in r.turns]) for r in cf.canonical_turns(df, payload="record").collect()}
    assert got == {
        0: ("messages", [("user", ""), ("assistant", "a")]),
        1: ("messages", [("user", ""), ("assistant", "a")]),
        2: ("prompt_completion", [("user", "p"), ("assistant", "")]),
        3: ("prompt_completion", [("user", ""), ("assistant", "")]),
        4: ("instruction_input_output", [("user", "i"), ("assistant", "o")]),
        5: ("messages", [("", "c")]),
        6: ("prompt_completion", [("user", "p"), ("assistant", "c")]),
        7: (None, []),
    }


def test_records_with_two_layouts(spark):
    said = [{"role": "user", "content": "p"}, {"role": "assistant", "content": "a"}]
    told = [{"from": "human", "value": "h"}]
    records = [{"prompt": "p", "messages": said}, {"system": "s", "messages": said}, {"system": "", "messages": said}, {"system": "s", "conversations": told}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "conv_id long, record string")
    got = {r.conv_id: (r.layout, [tuple(t) for t in r.turns]) for r in cf.canonical_turns(df, payload="record").collect()}
    both = [("user", "p"), ("assistant", "a")]
    assert got == {
        0: ("prompt_messages", both),
        1: ("system_messages", [("system", "s"), *both]),
        2: ("system_messages", both),
        3: ("system_conversations", [("system", "s"), ("user", "h")]),
    }
    table = spark.createDataFrame([(1, "p", [("user", "u")])], "id long, prompt string, messages array<struct<role:string,content:string>>")
    assert [(r.layout, [tuple(t) for t in r.turns]) for r in cf.canonical_turns(table, "id").collect()] == [("prompt_messages", [("user", "u")])]


def test_layout_of_a_table(spark):
    pairs = spark.createDataFrame([(1, "q", None, "x")], "id long, question string, answer string, lang string")
    assert [(r.layout, [tuple(t) for t in r.turns]) for r in cf.canonical_turns(pairs, "id").collect()] == [("question_answer", [("user", "q"), ("assistant", "")])]
    nested = spark.createDataFrame([(1, [("user", "u")])], "id long, messages array<struct<role:string,content:string>>")
    assert [tuple(t) for t in cf.canonical_turns(nested, "id").first().turns] == [("user", "u")]


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = cf.format_chat(cf.canonical_turns(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
