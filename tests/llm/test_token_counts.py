import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from postmill.llm import token_counts
from postmill.llm.common import chunks_by_size

PATH = public_tokenizers.path("byte_bpe_50k.json")
SIGNS = "abcdest'vrelmd  \n\t.,!?019éß漢字🚀\u0085​　 ٣½"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_hard_cases(library):
    texts = ["", " ", "a", "   \n\n x", "'s 're're''ll '", "it's they'RE", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "x" * 3_000, "é" * 500, " " * 999 + "y"]
    sizes, counts = token_counts.machine(PATH).count(texts)
    assert counts.tolist() == expected(library, texts)
    assert sizes.tolist() == [len(t.encode()) for t in texts]


def test_long_texts_in_pieces(library):
    rng = random.Random(5)
    own = token_counts.machine(PATH)
    texts = ["".join(rng.choices(SIGNS, k=3_000)) for _ in range(20)]
    texts += ["it's " * 500, "a<|endoftext|> b" * 300, "漢字。" * 700, "x" * 2_000, " " * 2_000 + "y", "", "don't' re'rest a  b\n\n c" * 90]
    for text, n in zip(texts, expected(library, texts)):
        for size in (1, 7, 500):
            assert own.count_long(text, size) == (len(text.encode()), n)


def test_rows_longer_than_a_block(spark, library, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_CHARS", 1_000)
    texts = ["some words, and more. " * 400, "short", None, "tail's end " * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(df, PATH).collect()}
    assert rows == {i: (len((t or "").encode()), n) for (i, t), n in zip(enumerate(texts), expected(library, [t or "" for t in texts]))}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=SIGNS, max_size=200), min_size=1, max_size=8))
def test_random_texts(texts):
    library = Tokenizer.from_file(PATH)
    assert token_counts.machine(PATH).count(texts)[1].tolist() == expected(library, texts)


def test_dropping_states_changes_nothing(library, monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice(SIGNS) for _ in range(400)) for _ in range(40)]
    monkeypatch.setattr(token_counts, "MAX_STATES", 50)
    own = token_counts.TokenMachine(PATH)
    counts = [n for lo, hi in chunks_by_size(texts, 1_000) for n in own.count(texts[lo:hi])[1]]
    assert counts == expected(library, texts)


def test_rows_nulls_repeats_and_other_columns(spark, library):
    rows = [(1, "two words", "x"), (1, "two words", "x"), (2, None, "y"), (None, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(token_counts.count_tokens(df, PATH).collect(), key=str)
    two = expected(library, ["two words"])[0]
    assert got == sorted([(1, 9, two), (1, 9, two), (2, 0, 0), (None, 0, 0)], key=str)
    assert token_counts.count_tokens(df.limit(0), PATH).collect() == []


def test_composed_chunks_equal_one_pass(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice(SIGNS) for _ in range(2_000))
    whole = token_counts.machine(PATH).count([text])[1].tolist()
    for size in (1, 2, 7, 5_000):
        monkeypatch.setattr(token_counts, "CHUNK", size)
        assert token_counts.machine(PATH).count([text])[1].tolist() == whole
