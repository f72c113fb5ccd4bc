"""Benchmark decontamination: a broadcast hash set of benchmark word windows, scanned over documents, hits verified.

Of the short word runs ("anchors") in a benchmark window, the one with the smallest hash stands for it, so windows that
overlap mostly share one. Every document run of that length is hashed and looked up among the anchors; wherever one is
found, the window it stands for is compared word by word. An occurrence of a window always holds its anchor, so none
is missed. Everything is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import materialise

WINDOW = 13
ANCHOR = 3
BROADCAST_BYTES = 64 << 20  # a larger table of anchors or windows is joined as Catalyst sees fit
ANCHOR_BYTES = 32  # of a row of the anchor table: length, hash, place and window id

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A to Z in lower case, all else as it is; texts of ASCII only take the fast way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    """Words of a text: runs of digits, letters and characters beyond ASCII. None for NULL."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _BETWEEN), "")


def runs(words_col: str, k: int) -> Column:
    """Hashes of all runs of ``k`` words, by place from 0."""
    starts = F.sequence(F.lit(1), F.size(words_col) - (k - 1))
    hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col(words_col), i + (j - 1)) for j in range(k)]))
    return F.when(F.size(words_col) >= k, hashed).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per distinct window: its words, anchor (hash, length, place) and the items that hold it."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("_words"))
    items = items.where(F.size("_words") > 0)
    length = F.least(F.size("_words"), F.lit(window))
    places = F.sequence(F.lit(1), F.size("_words") - length + 1)
    windows = items.select("item", F.explode(F.transform(places, lambda i: F.slice("_words", i, length))).alias("window"))
    distinct = windows.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = None
    for k in range(1, ANCHOR + 1):
        rank = F.transform(runs("window", k), lambda h, i: F.struct(h.alias("hash"), i.alias("place")))
        own = F.size("window") == k if k < ANCHOR else F.size("window") >= k
        rows = distinct.where(own).select("window", "items", F.lit(k).alias("k"), F.array_min(rank).alias("anchor"))
        found = rows if found is None else found.unionByName(rows)
    return found.select(F.xxhash64(F.array_join("window", " ")).alias("window_id"), "window", "items", "k", "anchor.hash", "anchor.place")


def _maybe_broadcast(df: DataFrame, n_bytes: int) -> DataFrame:
    return F.broadcast(df) if n_bytes <= BROADCAST_BYTES else df


def _string_bytes(strings: Column) -> Column:
    """Bytes of an array of strings in a row, with 16 for the place of each."""
    return F.aggregate(strings, F.lit(0).cast("long"), lambda n, s: n + F.octet_length(s) + 16)


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def contamination(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``(key, hits, items)``, a row per distinct document text that holds a window: the places of its hit words from
    0, and the sorted ids of the items found. ``key`` is the MD5 of the text. Runs jobs."""
    windows = materialise(benchmark_windows(benchmark, text_col="text", window=window), "windows")
    per_window = _string_bytes(F.col("window")) + _string_bytes(F.col("items"))
    sizes = windows.agg(F.count("*").alias("n"), F.coalesce(F.sum(per_window), F.lit(0)).alias("n_bytes")).first()
    anchors = windows.select("k", "hash", "place", "window_id")
    texts = documents.select(F.col(text_col).alias("text"))
    keyed = texts.select(text_key(F.col("text")).alias("key"), words(F.col("text")).alias("_words"))
    met = None
    for k in sorted(r.k for r in windows.select("k").distinct().collect()) or [ANCHOR]:
        at = keyed.select("key", F.posexplode(runs("_words", k)).alias("at", "hash"))
        own = _maybe_broadcast(anchors.where(F.col("k") == k).drop("k"), sizes.n * ANCHOR_BYTES)
        hit = at.join(own, "hash").where("at >= place").select("key", (F.col("at") - F.col("place")).alias("start"), "window_id")
        met = hit if met is None else met.unionByName(hit)
    candidates = materialise(met.distinct(), "window-candidates")
    compared = candidates.join(_maybe_broadcast(windows.select("window_id", "window", "items"), sizes.n_bytes), "window_id")
    per_text = compared.groupBy("key").agg(F.collect_list(F.struct("start", "window", "items")).alias("_candidates"))
    # Copies meet before the join: a text held by a third of all rows leaves each task once.
    suspects = (
        texts.groupBy(text_key(F.col("text")).alias("key")).agg(F.first("text").alias("text"))
        .join(candidates.select("key").distinct(), "key", "left_semi")
        .select("key", words(F.col("text")).alias("_words"))
    )
    verified = suspects.join(per_text, "key").withColumn(
        "_found", F.filter("_candidates", lambda c: F.slice(F.col("_words"), c["start"] + 1, F.size(c["window"])) == c["window"])
    )
    spans = F.transform("_found", lambda c: F.sequence(c["start"], c["start"] + F.size(c["window"]) - 1))
    return verified.where(F.size("_found") > 0).select(
        "key",
        F.array_sort(F.array_distinct(F.flatten(spans))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("_found", lambda c: c["items"])))).alias("items"),
    )


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def scan_documents(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``(id, n_words, n_hit, n_items, items, contaminated)`` for every row.

    A window is ``window`` consecutive words of an item, or all words of a shorter one; a document word inside any
    occurrence of a window is hit. A document is contaminated if one word in twenty is hit. NULL and empty texts have
    no words and are clean, items without words are no windows. Rows with equal texts are judged once and get equal
    results, so a text held by a third of all rows is searched once; repeated rows and NULL ids keep their rows. Other
    columns are not read. Empty tables give an empty or a clean result.
    """
    found = materialise(contamination(documents, benchmark, text_col, window), "contamination")
    found = found.select("key", F.size("hits").cast("long").alias("n_hit"), "items")
    rows = documents.select(
        F.col(id_col), text_key(F.col(text_col)).alias("key"), F.size(words(F.col(text_col))).cast("long").alias("n_words")
    )
    judged = rows.join(found, "key", "left").withColumns(
        {"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))}
    )
    return judged.select(
        id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated")
    )


def remove_contamination(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, spans: bool = False) -> DataFrame:
    """``documents`` without the contaminated rows, or with ``spans`` with all rows and without their hit words.

    A removed word takes the characters between it and the word before along. All columns are kept as they are
    otherwise, whatever their names; rows are treated as in ``scan_documents``.
    """
    found = materialise(contamination(documents, benchmark, text_col, window), "contamination")
    # The row goes along as one value, so that no column of it clashes with those made here.
    keyed = documents.select(F.struct("*").alias("_row"), text_key(F.col(text_col)).alias("_key"))
    hits = found.select(F.col("key").alias("_key"), F.col("hits").alias("_hits"))
    text = F.col("_row").getField(text_col)
    if not spans:
        # The keys grow with the corpus, so they are never broadcast: the same plan at every size.
        n_hits = hits.select("_key", F.size("_hits").alias("_n_hit")).hint("merge")
        joined = keyed.join(n_hits, "_key", "left")
        dirty = is_contaminated(F.coalesce("_n_hit", F.lit(0)), F.when(F.col("_n_hit") > 0, F.size(words(text))).otherwise(0))
        return joined.where(~dirty).select("_row.*")
    between = F.split(text, _WORD_ANY_CASE)
    said = F.array_remove(F.split(text, _BETWEEN_ANY_CASE), "")
    kept = F.zip_with(said, F.sequence(F.lit(0), F.size(said) - 1), lambda w, i: F.when(~F.array_contains("_hits", i), F.concat(F.get(between, i), w)))
    rebuilt = F.concat(F.array_join(kept, ""), F.element_at(between, -1))
    joined = keyed.join(hits, "_key", "left")
    cleaned = F.when(F.col("_hits").isNotNull(), rebuilt).otherwise(text).alias(text_col)
    return joined.select(*[cleaned if c == text_col else F.col("_row").getField(c).alias(c) for c in documents.columns])
