"""Sub-word encoding and token masking."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import fixed, text as tx
from postmill.functions.bind import bind
from postmill.operators.sampling import hash_number
from postmill.operators.skew import attach
from postmill.sources.scratch import materialise

PAD, UNK, CLS, SEP, MASK = "[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"
SPECIAL = [PAD, UNK, CLS, SEP, MASK, fixed.USER_TOKEN, fixed.URL_TOKEN]
MAX_LEN = 512
BROADCAST_TOKENS = 1_000_000  # a larger vocabulary is joined instead of broadcast
_MEMO = 200_000  # distinct words a Python worker remembers

# Mask tokens stay whole; otherwise a word is a run of letters, marks and digits, or one symbol.
_WORDS = rf"{fixed.USER_TOKEN}|\[URL\]|[{tx.WORD}\p{{M}}]++|[^{tx.SPACE}]"


def split_words(text: Column | str, limit: int | None = None) -> Column:
    """Lower-case words and symbols of a text, the first ``limit`` of them."""
    text = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(text, F.lit(_WORDS), 0)
    return F.transform(
        found if limit is None else F.slice(found, 1, limit),
        lambda w: F.when(w.isin(fixed.USER_TOKEN, fixed.URL_TOKEN), w).otherwise(F.lower(w)),
    )


def encode_words(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(word, ids)`` for distinct words: greedy longest match from the left, ``[UNK]`` if a rest has no match.

    ``vocab`` is a stored table ``(token string, id int)``, so that Catalyst knows its size; a token that
    continues a word starts with ``##``. All pieces of a word meet the vocabulary in one join. With a
    vocabulary small enough to broadcast, everything after ``distinct`` runs in one stage.
    """
    unk, longest = vocab.agg(F.max(F.when(F.col("token") == UNK, F.col("id"))), F.max(F.length("token"))).first()
    size = F.length("word")
    starts = F.explode(F.sequence(F.lit(1), size))
    ends = F.explode(F.sequence(F.lit(1), F.least(size - F.col("start") + 1, F.lit(longest))))
    piece = F.concat(F.when(F.col("start") == 1, "").otherwise("##"), F.substring("word", F.col("start"), F.col("len")))
    # Words are small but grow into all their pieces, so their partitions must not be merged by size.
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = (
        words.where(size > 0)
        .repartition(tasks, "word")
        .withColumn("start", starts)
        .withColumn("len", ends)
        .withColumn("token", piece)
    )
    # Length in front of id in one number: a long is aggregated by hash, a struct by sorting.
    code = F.shiftleft(F.col("len").cast("long"), 32) + F.col("id")
    best = pieces.join(vocab, "token").groupBy("word", "start").agg(F.max(code).alias("code"))
    matches = best.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("start", "code"))).alias("hits"))

    def step(state, start):
        moved = bind(
            F.element_at(F.col("hits"), start),
            lambda hit: F.when(
                hit.isNotNull(),
                F.struct(
                    (start + F.shiftright(hit, 32)).cast("int").alias("at"),
                    F.array_append(state["ids"], hit.bitwiseAND(0xFFFFFFFF).cast("int")).alias("ids"),
                ),
            ).otherwise(state),
        )
        return F.when(state["at"] == start, moved).otherwise(state)

    begin = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("ids"))
    walked = matches.withColumn("walk", F.aggregate(F.sequence(F.lit(1), size), begin, step))
    found = walked.select("word", F.when(F.col("walk.at") == size + 1, F.col("walk.ids")).alias("ids"))
    return words.join(found, "word", "left").select("word", F.coalesce("ids", F.array(F.lit(unk))).alias("ids"))


def word_encoder(vocab: dict[str, int]):
    """Ids of a word: greedy longest match from the left, ``[UNK]`` if a rest has no match."""
    longest, unknown, memo = max(map(len, vocab)), [vocab[UNK]], {}

    def ids(word: str) -> list[int]:
        known = memo.get(word)
        if known is not None:
            return known
        out, start = [], 0
        while start < len(word):
            prefix = "##" if start else ""
            for end in range(min(len(word), start + longest), start, -1):
                found = vocab.get(prefix + word[start:end])
                if found is not None:
                    out.append(found)
                    start = end
                    break
            else:
                out = unknown
                break
        if len(memo) >= _MEMO:
            memo.clear()
        memo[word] = out = out or unknown
        return out

    return ids


def _bodies(df: DataFrame, vocab: DataFrame, text_col: str, most: int) -> DataFrame:
    """Add ``_body``, the ids of a text's words, with a broadcast vocabulary: one narrow pass."""
    tokens = df.sparkSession.sparkContext.broadcast({row.token: row.id for row in vocab.collect()})

    @F.pandas_udf("array<int>")
    def body(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids = word_encoder(tokens.value)
        for words in texts:
            yield words.map(lambda own: None if own is None else list(islice((i for w in own for i in ids(w)), most)))

    return df.withColumn("_body", F.coalesce(body(split_words(text_col, most)), F.array().cast("array<int>")))


def _joined_bodies(df: DataFrame, vocab: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """The same by joins, for a vocabulary that is too large to broadcast."""
    occurrences = materialise(df.select(id_col, F.posexplode(split_words(text_col, most)).alias("pos", "word")), "words")
    table = materialise(encode_words(occurrences.select("word").distinct(), vocab), "encoded-words")
    pieces = attach(occurrences, table, "word", "inner", occurrences.count())
    rows = pieces.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("_pieces"))
    body = F.slice(F.flatten(F.transform("_pieces", lambda p: p["ids"])), 1, most)
    return df.join(rows, id_col, "left").withColumn("_body", F.coalesce(body, F.array().cast("array<int>"))).drop("_pieces")


def encode_corpus(df: DataFrame, vocab: DataFrame, id_col: str, text_col: str = "text", max_len: int = MAX_LEN) -> DataFrame:
    """Add ``input_ids``, ``token_type_ids`` and ``attention_mask`` of ``max_len`` entries each.

    Every word gives at least one id, so only the first ``max_len - 2`` words of a text can appear in its encoding and
    only these are looked up; a word may have any length. A vocabulary of up to a million tokens is broadcast and the
    corpus takes one narrow pass; a larger one is joined.
    """
    vocab = materialise(vocab.select("token", F.col("id").cast("int").alias("id")), "vocabulary")
    special = {row.token: row.id for row in vocab.where(F.col("token").isin(SPECIAL)).collect()}
    missing = {PAD, UNK, CLS, SEP} - special.keys()
    if missing:
        raise ValueError(f"vocabulary lacks {sorted(missing)}")
    if vocab.count() <= BROADCAST_TOKENS:
        encoded = _bodies(df, vocab, text_col, max_len - 2)
    else:
        encoded = _joined_bodies(df, vocab, id_col, text_col, max_len - 2)
    used = F.size("_body") + 2
    ids = F.concat(
        F.array(F.lit(special[CLS])), F.col("_body"), F.array(F.lit(special[SEP])), F.array_repeat(F.lit(special[PAD]), max_len - used)
    )
    columns = {
        "input_ids": ids,
        "token_type_ids": F.array_repeat(F.lit(0), max_len),
        "attention_mask": F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), max_len - used)),
    }
    return encoded.withColumns(columns).drop("_body")


def mlm_mask(df: DataFrame, id_col: str, vocab_size: int, mask_id: int, special_ids: list[int], p: float = 0.15, seed: int = 0) -> DataFrame:
    """Mask ``input_ids`` for masked-token training and add ``labels``.

    A chosen token becomes the mask token in 80 % of cases, a random token in 10 %, and stays in 10 %.
    ``labels`` holds the token at chosen places and -100 elsewhere. One MD5 per row seeds a modular hash of
    the position, so a position costs a few integer operations.
    """
    prime = 2_147_483_647  # products of two numbers below 2**31 fit a long

    def uniform(name: str, i: Column) -> Column:
        return (F.col(f"_{name}") * (i + 1) + F.col("_shift")) % prime

    seeds = {
        f"_{name}": hash_number(F.concat_ws(":", F.lit(f"{seed}:{name}"), F.col(id_col).cast("string"))) % (prime - 1) + 1
        for name in ("pick", "kind", "word", "shift")
    }

    def chosen(token: Column, i: Column) -> Column:
        return (uniform("pick", i) < int(p * prime)) & ~token.isin(special_ids)

    def masked(token: Column, i: Column) -> Column:
        kind = uniform("kind", i)
        replaced = (
            F.when(kind < int(0.8 * prime), F.lit(mask_id))
            .when(kind < int(0.9 * prime), (uniform("word", i) % vocab_size).cast("int"))
            .otherwise(token)
        )
        return F.when(chosen(token, i), replaced).otherwise(token)

    return (
        df.withColumns(seeds)
        .withColumn("labels", F.transform("input_ids", lambda t, i: F.when(chosen(t, i), t).otherwise(F.lit(-100))))
        .withColumn("input_ids", F.transform("input_ids", masked))
        .drop(*seeds)
    )
