"""Near-duplicate texts: links, groups, removal inside a corpus and against another corpus.

Two texts collide when they share a band of their MinHash signatures. A bucket of m colliding texts is
represented by m - 1 links to its lowest id, never by its m * (m - 1) / 2 pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions import fixed, text as tx
from postmill.operators import minhash
from postmill.operators.components import connected_components
from postmill.operators.corpus import drop_ids
from postmill.operators.setjoin import similar_sets, token_sets
from postmill.operators.skew import attach
from postmill.sources.scratch import materialise, scratch_path

SALTS = 4_096


@dataclass(frozen=True)
class Signed:
    """A corpus made ready for the search: ``bands (id, key)`` of every distinct text, under the lowest of its ids, and
    ``copies (id, first)``, the other ids of a text."""

    bands: DataFrame
    copies: DataFrame


def _text_hashes(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(id, hash)`` of every text and ``copies (id, first)``, the other ids of a text."""
    texts = df.where(F.col(text_col).isNotNull())
    hashes = materialise(texts.select(F.col(id_col).alias("id"), F.sha2(text_col, 256).alias("hash")), "text-hashes")
    repeated = hashes.groupBy("hash").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = materialise(repeated, "repeated-texts")
    return hashes, materialise(hashes.join(repeated, "hash").where("id <> first").select("id", "first"), "copies")


def _distinct_texts(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(name, id, text)`` of every distinct text, under 16 bytes of its hash and the lowest of its ids, and its copies."""
    _, copies = _text_hashes(df, id_col, text_col)
    first = drop_ids(df.where(F.col(text_col).isNotNull()), copies.select(F.col("id").alias(id_col)), id_col)
    name = F.substring(F.unhex(F.sha2(text_col, 256)), 1, 16).alias("name")
    return materialise(first.select(name, F.col(id_col).alias("id"), F.col(text_col).alias("text")), "distinct-texts"), copies


def sign_corpus(
    df: DataFrame,
    id_col: str,
    text_col: str = "text",
    threshold: float = fixed.THRESHOLD,
    num_perm: int = fixed.NUM_PERM,
    bands: int | None = None,
    rows: int | None = None,
) -> Signed:
    """Sign every distinct text once; written, since several later steps read the result."""
    if bands is None or rows is None:
        bands, rows = minhash.best_bands(threshold, num_perm)
    if bands * rows > num_perm:
        raise ValueError("bands * rows exceeds the number of permutations")
    texts = df.where(F.col(text_col).isNotNull())
    _, copies = _text_hashes(df, id_col, text_col)
    first = drop_ids(texts, copies.select(F.col("id").alias(id_col)), id_col)
    return Signed(materialise(minhash.band_keys(first, id_col, bands, rows, text_col, num_perm), "bands"), copies)


def _bucket_links(bands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(id, local)`` and ``(local, leader, n)`` rows of every bucket with at least two texts.

    A bucket is first cut into salted parts, each with its own lowest id, and only these meet to find the
    lowest id of all. A bucket with a third of all texts is spread over all salts; what meets in one place is
    one row per salt.
    """
    salted = bands.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    part = Window.partitionBy("key", "salt")
    local = salted.select("key", "id", F.min("id").over(part).alias("local"), F.count("*").over(part).alias("n_local"))
    bucket = Window.partitionBy("key")
    heads = local.where("id = local").select(
        "key", "local", F.min("local").over(bucket).alias("leader"), F.sum("n_local").over(bucket).alias("n")
    )
    return local.where("id <> local").select("key", "id", "local"), heads.where("n > 1")


def bucket_edges(bands: DataFrame) -> DataFrame:
    """``(a, b)``: a tree for every bucket of ``bands (id, key)`` with two texts or more."""
    down, heads = _bucket_links(bands)
    up = heads.where("local <> leader").select(F.col("local").alias("a"), F.col("leader").alias("b"))
    return up.unionByName(down.select(F.col("id").alias("a"), F.col("local").alias("b")))


def near_duplicate_pairs(
    df: DataFrame,
    id_col: str,
    text_col: str = "text",
    threshold: float = fixed.THRESHOLD,
    num_perm: int = fixed.NUM_PERM,
    bands: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """``(id, leader, jaccard)``: similar pairs that hold the near-duplicate groups together, a spanning forest of all pairs
    of similarity ``threshold`` or more.

    The similarity is exact, over the distinct tokens between single spaces, as 64-bit hashes. Copies of a text are linked
    to its lowest id with similarity 1 and searched for once. Candidates come from a prefix index, which misses no
    pair; with ``bands`` and ``rows`` they come from the bands of MinHash signatures instead, which may miss some but do
    not depend on rare tokens. Runs jobs.
    """
    texts, copies = _distinct_texts(df, id_col, text_col)
    keys = None
    if bands is not None and rows is not None:
        keys = materialise(minhash.band_keys(texts, "name", bands, rows, "text", num_perm).select(F.col("id").alias("name"), "key"), "bands")
    links = similar_sets(token_sets(texts, tx.space_tokens("text")), threshold, keys)
    ids = texts.select("name", "id")
    named = links.join(ids.withColumnsRenamed({"name": "a", "id": "_a"}), "a").join(ids.withColumnsRenamed({"name": "b", "id": "_b"}), "b")
    found = named.select(F.greatest("_a", "_b").alias("id"), F.least("_a", "_b").alias("leader"), "jaccard")
    return found.unionByName(copies.select("id", F.col("first").alias("leader"), F.lit(1.0).alias("jaccard")))


def _with_copies(groups: DataFrame, copies: DataFrame) -> DataFrame:
    """Groups of distinct texts with the other ids of each text; a repeated text without a group makes one."""
    first = copies.select(F.col("first").alias("id")).distinct()
    own = first.join(groups.select("id").distinct(), "id", "left_anti").select("id", F.col("id").alias("group_id"))
    every = groups.unionByName(own)
    more = copies.join(every.select(F.col("id").alias("first"), "group_id"), "first").select("id", "group_id")
    return every.unionByName(more)


def signed_groups(signed: Signed) -> DataFrame:
    """``(id, group_id)``, connected by collisions."""
    groups = connected_components(bucket_edges(signed.bands)).select("id", F.col("component").alias("group_id"))
    return _with_copies(materialise(groups, "groups"), signed.copies)


def near_duplicate_groups(
    df: DataFrame,
    id_col: str,
    text_col: str = "text",
    threshold: float = fixed.THRESHOLD,
    num_perm: int = fixed.NUM_PERM,
    bands: int | None = None,
    rows: int | None = None,
    grouping: str = "components",
    verify: bool = False,
    order: str = "id",
) -> DataFrame:
    """``(id, group_id)`` for every text that is in a group; a group is named by its lowest id, a star by its centre.

    ``components`` joins texts that are connected by collisions in the bands that fit the threshold, or with ``verify``
    by similar pairs, none of which is missed; see ``near_duplicate_pairs``.
    ``star`` walks the texts and lets each that is in no group yet open one with all texts it collides with, so groups
    may overlap. The walk goes upwards by id, or with ``order="hash"`` by the MD5 of the lowest id of a text, which takes
    few rounds whatever the texts.
    """
    if grouping not in ("components", "star"):
        raise ValueError(f"unknown grouping {grouping!r}")
    if order not in ("id", "hash"):
        raise ValueError(f"unknown order {order!r}")
    if verify:
        if grouping == "star":
            raise ValueError("star groups are built from collisions alone")
        pairs = near_duplicate_pairs(df, id_col, text_col, threshold, num_perm, bands, rows)
        edges = pairs.select(F.col("id").alias("a"), F.col("leader").alias("b"))
        return connected_components(edges).select("id", F.col("component").alias("group_id"))
    signed = sign_corpus(df, id_col, text_col, threshold, num_perm, bands, rows)
    if grouping == "star":
        return _with_copies(materialise(_star_groups(signed.bands, order), "star-groups"), signed.copies)
    return signed_groups(signed)


def _star_groups(bands: DataFrame, order: str = "id") -> DataFrame:
    """Rounds of the walk: a text opens a group once it is the first open one in all its buckets.

    There are as many rounds as the longest chain of texts in walking order in which each collides with the next: by id that
    may be as long as the corpus, by a hash of the id it grows with the logarithm of it. Every round appends its centres
    to one written table.
    """
    sizes = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    n_rows = bands.count()
    place = F.col("id") if order == "id" else F.md5(F.col("id").cast("string"))
    rows = materialise(attach(bands, sizes, "key", "inner", n_rows).withColumn("place", place), "buckets")
    spark, path = bands.sparkSession, scratch_path(bands.sparkSession, "centres")
    schema = rows.select("key", F.col("id").alias("group_id")).schema
    open_rows, rounds = rows, 0
    while not open_rows.isEmpty():
        first = open_rows.groupBy("key").agg(F.min("place").alias("first"))
        seen = materialise(attach(open_rows, first, "key", "inner", n_rows), "first-open")
        centres = seen.groupBy("id").agg(F.bool_and(F.col("place") == F.col("first")).alias("opens")).where("opens")
        own = seen.join(centres.select("id"), "id", "left_semi").select("key", F.col("id").alias("group_id"))
        own.write.parquet(f"{path}/round={rounds}")
        owned = spark.read.schema(schema).parquet(f"{path}/round={rounds}")
        covered = attach(open_rows, owned, "key", "inner", n_rows).select("id").distinct()
        open_rows = materialise(open_rows.join(covered, "id", "left_anti"), "open")
        rounds += 1
    if not rounds:
        return rows.select("id", F.col("id").alias("group_id"))
    owners = spark.read.schema(schema).parquet(path).select("key", "group_id")
    return attach(rows, owners, "key", "inner", n_rows).select("id", "group_id").distinct()


def remove_near_duplicates(df: DataFrame, id_col: str, text_col: str = "text", **search) -> DataFrame:
    """Keep the text that names each group, and all texts without a group."""
    groups = materialise(near_duplicate_groups(df, id_col, text_col, **search), "all-groups")
    kept = groups.where("id = group_id").select("id")
    dropped = groups.where("id <> group_id").select("id").distinct().join(kept, "id", "left_anti")
    return drop_ids(df, dropped.withColumnRenamed("id", id_col), id_col)


def overlapping(ours: Signed, theirs: Signed, drop_internal: bool = False) -> DataFrame:
    """``(id)`` of our texts that collide with one of theirs or, with ``drop_internal``, with another of ours."""
    keys = theirs.bands.select("key")
    if drop_internal:
        repeated = ours.bands.groupBy("key").agg(F.count("*").alias("n"))
        keys = keys.unionByName(repeated.where("n > 1").select("key"))
    hits = attach(ours.bands, keys.distinct(), "key", "inner", ours.bands.count()).select("id")
    if drop_internal:
        hits = hits.unionByName(ours.copies.select(F.col("first").alias("id")))
    hits = materialise(hits.distinct(), "overlap")
    return hits.unionByName(ours.copies.join(hits.withColumnRenamed("id", "first"), "first").select("id"))


def remove_overlap(
    candidate: DataFrame,
    base: DataFrame,
    id_col: str,
    text_col: str = "text",
    base_id_col: str | None = None,
    base_text_col: str | None = None,
    threshold: float = fixed.THRESHOLD,
    num_perm: int = fixed.NUM_PERM,
    bands: int | None = None,
    rows: int | None = None,
    drop_internal: bool = False,
    verify: bool = False,
) -> DataFrame:
    """Drop candidate texts that collide with a base text.

    ``drop_internal`` also drops candidates that collide with one another, every copy of them. With ``verify`` both
    corpora are searched as one: candidates in a verified group with a base text, or with ``drop_internal`` in any
    verified group, are dropped.
    """
    search = {"threshold": threshold, "num_perm": num_perm, "bands": bands, "rows": rows}
    base_id, base_text = base_id_col or id_col, base_text_col or text_col
    if verify:
        ours = candidate.select(F.lit(1).alias("side"), F.col(id_col).alias("own"), F.col(text_col).alias("text"))
        theirs = base.select(F.lit(0).alias("side"), F.col(base_id).alias("own"), F.col(base_text).alias("text"))
        both = materialise(ours.unionByName(theirs).select(F.struct("side", "own").alias("id"), "text"), "both")
        groups = materialise(near_duplicate_groups(both, "id", "text", verify=True, **search), "both-groups")
        # A group is named by its lowest id, and base ids are below all others.
        hit = F.col("id.side") == 1 if drop_internal else (F.col("id.side") == 1) & (F.col("group_id.side") == 0)
        return drop_ids(candidate, groups.where(hit).select(F.col("id.own").alias(id_col)), id_col)
    ours = sign_corpus(candidate, id_col, text_col, **search)
    theirs = sign_corpus(base, base_id, base_text, **search)
    return drop_ids(candidate, overlapping(ours, theirs, drop_internal).select(F.col("id").alias(id_col)), id_col)


def group_report(groups: DataFrame, df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Every member of every group with its text."""
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return groups.join(texts, "id").select("group_id", "id", "text")
