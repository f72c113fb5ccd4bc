"""Seeded splits, folds and oversampling.

Every random choice is an MD5 of seed and id, so it depends neither on partitioning nor on the number of
executors. An exact sample size normally needs a global sort; here a histogram over hash prefixes finds the
cut key in light passes over the ids alone, and the split is then a comparison on each row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions import fixed
from postmill.sources.scratch import materialise

PREFIX = 5  # hex digits: about a million histogram buckets, each one row of the histogram
CLASS_PREFIX = 4
DRAWS_PER_TASK_ROW = 100_000
COPIES_PER_ROW = 10_000


def seeded_key(id_col: Column | str, seed: int) -> Column:
    """A pseudo-random sort key for an id."""
    ident = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), ident.cast("string")))


def hash_number(text: Column) -> Column:
    """60 uniform bits from the MD5 of a string."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def cut_keys(df: DataFrame, id_col: str, seed: int, positions: Callable[[int], Sequence[int]]) -> list[str]:
    """Keys at the given 1-based positions of the seeded order; ``positions`` receives the row count.

    Only the histogram and, from it, one bucket per position are looked at again, so what reaches one task is
    about a millionth of the rows, and what reaches the driver is one key per position.
    """
    keys = df.select(seeded_key(id_col, seed).alias("key"))
    bucket = F.substring("key", 1, PREFIX)
    hist = materialise(keys.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")), "key-histogram")
    total = hist.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    wanted = sorted({p for p in positions(total) if 0 < p <= total})
    if not wanted:
        return []
    upto = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    running = hist.withColumn("upto", upto).withColumn("p", F.explode(F.array(*[F.lit(p) for p in wanted])))
    hits = running.where((F.col("p") <= F.col("upto")) & (F.col("p") > F.col("upto") - F.col("n")))
    ranks = {(row.bucket, row.p - (row.upto - row.n)) for row in hits.collect()}
    inside = Window.partitionBy("bucket").orderBy("key")
    ranked = (
        keys.withColumn("bucket", bucket)
        .where(F.col("bucket").isin(sorted({b for b, _ in ranks})))
        .withColumn("rank", F.row_number().over(inside))
    )
    picked = reduce(lambda a, b: a | b, [(F.col("bucket") == b) & (F.col("rank") == r) for b, r in ranks])
    return sorted(row.key for row in ranked.where(picked).select("key").collect())


def train_val_split(df: DataFrame, frac: float, id_col: str, seed: int = 42, exact: bool = True) -> DataFrame:
    """Add ``split``: ``validation`` for ``frac`` of the rows, rounded half to even, ``train`` for the rest.

    ``exact=False`` takes each row with probability ``frac`` and needs no pass at all.
    """
    if not 0 <= frac <= 1:
        raise ValueError("frac must be between 0 and 1")
    key = seeded_key(id_col, seed)
    if not exact:
        limit = format(int(frac * 16**12), "012x")
        chosen = F.lit(True) if frac == 1 else key < limit
    else:
        cuts = cut_keys(df, id_col, seed, lambda n: [round(frac * n)])
        chosen = (key <= cuts[0]) if cuts else F.lit(False)
    return df.withColumn("split", F.when(chosen, "validation").otherwise("train"))


def kfold(df: DataFrame, id_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` in 0..k-1; the first ``n mod k`` folds hold one row more."""
    if k < 2:
        raise ValueError("k must be at least 2")
    cuts = cut_keys(df, id_col, seed, lambda n: [i * (n // k) + min(i, n % k) for i in range(1, k)])
    key = F.col("_key")
    fold = reduce(lambda a, b: a + b, [(key > cut).cast("int") for cut in cuts], F.lit(0))
    return df.withColumn("_key", seeded_key(id_col, seed)).withColumn("fold", fold).drop("_key")


def fold_sides(df: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """Training and validation side of one fold."""
    return df.where(F.col("fold") != fold), df.where(F.col("fold") == fold)


def rank_in_class(df: DataFrame, id_col: str, label_col: str, seed: int) -> DataFrame:
    """``(id, label, rank)`` with a 0-based seeded rank inside every class.

    A class may hold most rows, so rows are numbered per class and hash prefix and shifted by the size of the
    lower prefixes; no task sees a whole class.
    """
    keyed = df.where(F.col(label_col).isNotNull()).select(id_col, label_col, seeded_key(id_col, seed).alias("_key"))
    return number_in_class(keyed, label_col, [id_col]).select(id_col, label_col, "rank")


def number_in_class(keyed: DataFrame, label_col: str, ties: Sequence[str]) -> DataFrame:
    """Add ``rank``, 0-based inside every class in the order of ``_key``, an MD5, and ``ties``."""
    keyed = keyed.withColumn("_bucket", F.substring("_key", 1, CLASS_PREFIX))
    lower = Window.partitionBy(label_col).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        keyed.groupBy(label_col, "_bucket")
        .agg(F.count("*").alias("_n"))
        .withColumn("_shift", F.coalesce(F.sum("_n").over(lower), F.lit(0)))
        .drop("_n")
    )
    inside = F.row_number().over(Window.partitionBy(label_col, "_bucket").orderBy("_key", *ties)) - 1
    ranked = keyed.withColumn("_inside", inside).join(shift, [label_col, "_bucket"])
    return ranked.withColumn("rank", F.col("_inside") + F.col("_shift")).drop("_inside", "_shift", "_bucket")


def oversample_draws(df: DataFrame, id_col: str, label_col: str = "label", seed: int = 0) -> DataFrame:
    """``(id, copies)``: how often each row is drawn to lift its class to the size of the largest one.

    Draws are with replacement. Draw numbers are generated in chunks spread over all tasks and counted per
    drawn row before they are shuffled to it.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(label_col).isNotNull()).groupBy(label_col).agg(F.count("*").alias("_size"))
    need = F.max("_size").over(Window.partitionBy()) - F.col("_size")
    chunk = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_need") - 1) / DRAWS_PER_TASK_ROW))
    start = F.col("_chunk") * DRAWS_PER_TASK_ROW
    draw = F.sequence(start, F.least(start + DRAWS_PER_TASK_ROW, F.col("_need")) - 1)
    pick = hash_number(F.concat_ws(":", F.lit(str(seed)), F.col(label_col).cast("string"), F.col("_draw").cast("string")))
    drawn = (
        counts.withColumn("_need", need)
        .where("_need > 0")
        .withColumn("_chunk", F.explode(chunk))
        .repartition(tasks, label_col, "_chunk")
        .withColumn("_draw", F.explode(draw))
        .select(label_col, (pick % F.col("_size")).alias("rank"))
        .groupBy(label_col, "rank")
        .agg(F.count("*").alias("copies"))
    )
    return rank_in_class(df, id_col, label_col, seed).join(drawn, [label_col, "rank"]).select(id_col, "copies")


def oversample(df: DataFrame, id_col: str, label_col: str = "label", seed: int = 0, draws: DataFrame | None = None) -> DataFrame:
    """All rows (``copy`` 0) and, numbered from 1, the drawn copies that make all classes equally large.

    Texts travel once, keyed by id, next to a copy count. A row drawn very often is cut into pieces that are
    spread over all tasks before they are expanded. ``draws`` is a written result of ``oversample_draws``, if there is one.
    """
    if draws is None:
        draws = materialise(oversample_draws(df, id_col, label_col, seed), "draws")
    here = F.least(F.coalesce("copies", F.lit(0)), F.lit(COPIES_PER_ROW)).cast("long")
    first = F.explode(F.sequence(F.lit(0).cast("long"), here))
    balanced = df.join(draws, id_col, "left").withColumn("copy", first).drop("copies")
    heavy = draws.where(F.col("copies") > COPIES_PER_ROW)
    if heavy.isEmpty():
        return balanced
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    piece = F.sequence(F.lit(1).cast("long"), F.floor((F.col("copies") - 1) / COPIES_PER_ROW))
    start = F.col("_piece") * COPIES_PER_ROW
    rest = (
        df.join(heavy, id_col)
        .withColumn("_piece", F.explode(piece))
        .repartition(tasks, id_col, "_piece")
        .withColumn("copy", F.explode(F.sequence(start + 1, F.least(start + COPIES_PER_ROW, F.col("copies")))))
        .drop("copies", "_piece")
    )
    return balanced.unionByName(rest)


def sample_per_class(
    df: DataFrame, id_col: str, label_col: str = "label", n: int = fixed.EXAMPLES_PER_PROMPT, requests: int = 1, seed: int = 0
) -> DataFrame:
    """``(label, request, position, id)``: ``n`` rows of every class for each request, drawn without replacement.

    Requests take turns along one seeded order of the class and start over at its end, so they share rows only
    when a class has fewer than ``n * requests``. A histogram over hash prefixes tells how far into the order
    that reaches; rows beyond are filtered out and only the few others are ranked. A class with fewer than
    ``n`` rows gives all of them to every request.
    """
    most = n * requests
    keyed = df.where(F.col(label_col).isNotNull()).select(id_col, label_col, seeded_key(id_col, seed).alias("_key"))
    keyed = keyed.withColumn("_bucket", F.substring("_key", 1, CLASS_PREFIX))
    upto = F.sum("_n").over(Window.partitionBy(label_col).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    hist = keyed.groupBy(label_col, "_bucket").agg(F.count("*").alias("_n")).withColumn("_before", upto - F.col("_n"))
    reach = hist.groupBy(label_col).agg(
        F.max(F.when(F.col("_before") < most, F.col("_bucket"))).alias("last"), F.sum("_n").alias("size")
    )
    classes = reach.collect()  # one row per class
    if not classes:
        return keyed.select(label_col, F.lit(0).alias("request"), F.lit(0).alias("position"), id_col)
    near = reduce(lambda a, b: a | b, [(F.col(label_col) == c[label_col]) & (F.col("_bucket") <= c["last"]) for c in classes])
    # Numbered per class and hash prefix, so no task ranks a whole class; the prefixes taken are the lowest ones.
    ranked = rank_in_class(keyed.where(near).select(id_col, label_col), id_col, label_col, seed).where(F.col("rank") < most)
    # The schedule is made where it is needed: every task numbers its own slots.
    spark = df.sparkSession
    slots = spark.range(len(classes) * requests * n)
    entry = F.get(F.array(*[F.struct(F.lit(c[label_col]).alias("label"), F.lit(c["size"]).alias("size")) for c in classes]), F.floor(F.col("id") / (requests * n)).cast("int"))
    request, position = F.floor(F.col("id") / n) % requests, F.col("id") % n
    schedule = (
        slots.select(entry.alias("_class"), request.cast("int").alias("request"), position.cast("int").alias("position"))
        .where(F.col("position") < F.col("_class.size"))
        .select(
            F.col("_class.label").cast(df.schema[label_col].dataType).alias(label_col),
            "request",
            "position",
            ((F.col("request").cast("long") * n + F.col("position")) % F.col("_class.size")).alias("rank"),
        )
    )
    return ranked.join(schedule, [label_col, "rank"]).select(label_col, "request", "position", id_col)
