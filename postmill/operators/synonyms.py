"""Oversampling whose copies are rewritten with synonyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.bind import with_once
from postmill.operators.sampling import hash_number, oversample, oversample_draws
from postmill.operators.skew import attach
from postmill.sources.scratch import materialise

SHARE = 0.3
AT_LEAST = 1
AT_MOST = 10


_PRIME = 2_147_483_647  # products of two numbers below 2**31 fit a long


def synonym_oversample(
    df: DataFrame,
    synonyms: DataFrame,
    id_col: str,
    text_col: str = "text",
    label_col: str = "label",
    seed: int = 0,
    share: float = SHARE,
    at_least: int = AT_LEAST,
    at_most: int | None = AT_MOST,
) -> DataFrame:
    """Oversample, and in every copy replace some words by a synonym.

    ``synonyms`` has rows ``(token, synonym)``. Of the words that have a synonym, ``share`` of the text's words, but
    ``at_least`` and ``at_most`` so many (None: no bound), are replaced; choice and order follow the seed. Originals are
    unchanged. Places and synonyms are attached once to every drawn text, before its copies are made; a copy takes one
    MD5, from which a modular hash of the place decides.
    """
    draws = materialise(oversample_draws(df, id_col, label_col, seed), "draws")
    choices = materialise(synonyms.groupBy("token").agg(F.array_sort(F.collect_set("synonym")).alias("choices")), "choices")
    drawn = df.select(id_col, text_col).join(draws.select(id_col), id_col, "left_semi")
    occurrences = materialise(
        drawn.select(id_col, F.posexplode(F.split(text_col, " ", -1)).alias("pos", "_word")).select(id_col, "pos", F.lower("_word").alias("token")),
        "words",
    )
    n_words = occurrences.count()
    known = materialise(attach(occurrences, choices.select("token"), "token", "inner", n_words), "known-words")
    places = known.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("_slots"))
    own = known.select(id_col, "token").distinct()
    own = attach(own, choices, "token", "inner", n_words).groupBy(id_col)
    slots = places.join(own.agg(F.map_from_entries(F.collect_list(F.struct("token", "choices"))).alias("_choices")), id_col)
    prepared = materialise(df.join(slots, id_col, "left"), "with-slots")
    balanced = oversample(prepared, id_col, label_col, seed, draws)
    seeds = {
        f"_{what}": hash_number(F.concat_ws(":", F.lit(f"{seed}:{what}"), F.col(id_col).cast("string"), F.col("copy").cast("string"))) % (_PRIME - 1) + 1
        for what in ("where", "which", "shift")
    }

    def number(what: str, pos: Column) -> Column:
        return (F.col(f"_{what}") * (pos + 1) + F.col("_shift")) % _PRIME

    order = F.array_sort(F.transform("_slots", lambda s: F.struct(number("where", s["pos"]).alias("o"), s["pos"].alias("pos"), s["token"].alias("token"))))
    wanted = F.floor(share * F.size("_words"))
    wanted = F.greatest(F.lit(at_least), wanted if at_most is None else F.least(F.lit(at_most), wanted)).cast("int")

    def swap(s: Column) -> Column:
        own = F.col("_choices")[s["token"]]
        return F.struct(s["pos"], F.element_at(own, (number("which", s["pos"]) % F.size(own)).cast("int") + 1))

    copies = balanced.where("copy > 0 AND _slots IS NOT NULL").withColumns(seeds).withColumn("_words", F.split(text_col, " ", -1))
    # Behind a generator, else the map would be made anew for every word.
    swapped = with_once(with_once(copies, "_chosen", F.slice(order, 1, wanted)), "_swaps", F.map_from_entries(F.transform("_chosen", swap)))
    rewritten = swapped.withColumn(text_col, F.array_join(F.transform("_words", lambda w, i: F.coalesce(F.col("_swaps")[i], w)), " "))
    columns = [*df.columns, "copy"]
    return balanced.where("copy = 0 OR _slots IS NULL").select(*columns).unionByName(rewritten.select(*columns))


def balance(df: DataFrame, mode: str | None, id_col: str, label_col: str = "label", seed: int = 0, synonyms: DataFrame | None = None) -> DataFrame:
    """Balance classes by ``simple`` or ``synonym`` oversampling, or not at all, with a ``copy`` number."""
    if mode == "simple":
        return oversample(df, id_col, label_col, seed)
    if mode == "synonym":
        if synonyms is None:
            raise ValueError("synonym oversampling needs a synonym table")
        return synonym_oversample(df, synonyms, id_col, label_col=label_col, seed=seed)
    if mode in (None, "", "none"):
        return df.withColumn("copy", F.lit(0).cast("long"))
    raise ValueError(f"unknown mode {mode!r}")
