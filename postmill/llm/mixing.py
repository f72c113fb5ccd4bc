"""Mixing sources to target weights by Pfair scheduling.

A source of weight w out of W gives its i-th block (from 0) the release time floor(i W / w) and the deadline
ceil((i + 1) W / w). Taking, slot by slot, the released block with the earliest deadline meets every deadline, so at
any slot each source has been served within less than one block of its share. With whole-number weights the schedule
repeats after W slots: one period is computed, and the slot of any block follows by arithmetic in Spark.

When a source has no blocks left, a new phase begins in which the others share the slots by their weights.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import materialise

BLOCK = 64
SALTS = 1_024
#: Most pools there may be; a schedule has up to one row per pair of pools.
MAX_POOLS = 256
OTHERS = "*"


def period(weights: Mapping[str, int]) -> list[str]:
    """The source of every slot of one period, earliest deadline first among the released blocks."""
    total = sum(weights.values())
    waiting = sorted(((i * total // w, -(-(i + 1) * total // w), name) for name, w in weights.items() for i in range(w)), reverse=True)
    ready: list[tuple[int, str]] = []
    out = []
    for slot in range(total):
        while waiting and waiting[-1][0] <= slot:
            _, deadline, name = waiting.pop()
            heapq.heappush(ready, (deadline, name))
        deadline, name = heapq.heappop(ready)
        assert deadline > slot
        out.append(name)
    return out


def phases(blocks: Mapping[str, int], weights: Mapping[str, int]) -> list[tuple[str, int, int, int, int, list[int]]]:
    """``(source, first block, end block, first slot, period, slots within a period)`` for every source and phase."""
    left = {name: n for name, n in blocks.items() if n}
    done = dict.fromkeys(left, 0)
    start, out = 0, []
    while left:
        shares = {name: weights[name] for name in left}
        slots: dict[str, list[int]] = {name: [] for name in left}
        order = period(shares)
        for slot, name in enumerate(order):
            slots[name].append(slot)
        # The phase ends with the last block of the source that runs out first.
        last = {name: (n - 1) // shares[name] * len(order) + slots[name][(n - 1) % shares[name]] for name, n in left.items()}
        length = min(last.values()) + 1
        whole, part = divmod(length, len(order))
        for name in list(left):
            served = whole * shares[name] + sum(slot < part for slot in slots[name])
            out.append((name, done[name], done[name] + served, start, len(order), slots[name]))
            done[name] += served
            left[name] -= served
            if not left[name]:
                del left[name]
        start += length
    return out


MIX_COLUMNS = ("mix_pool", "mix_block", "mix_slot", "mix_position")


def mix_sources(df: DataFrame, weights: Mapping[str, int], id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """All rows of ``df`` with ``mix_pool``, ``mix_block``, ``mix_slot`` and ``mix_position``, gapless from 0.

    Every source is a pool of its own, with its release times and deadlines. ``weights`` are positive whole numbers by
    source; a source it does not name has the weight under ``"*"`` (1 if absent). Rows whose source is NULL form the pool
    ``"*"``, with rows of a source of that very name. More than 256 pools raise: map sources to fewer. Within a pool rows come in the order of a hash of their id, in blocks of ``block``
    rows; the last block of a pool may be short. Nothing is dropped or repeated: when a pool is used up the others go
    on in the ratio of their weights. Repeated rows are rows like others. Columns of ``df`` of the four names above are
    replaced, others kept whatever their names. An empty table gives an empty result.

    The first pass counts the rows of every pool and salt, of which there are 1,024 per pool. From the counts follows
    where each salt begins in the schedule, so the second pass moves every row once, to the partition of its place, and
    numbers it there; no task holds more of a pool than its salts there. Plan and broadcast tables have at most one row
    per pair of pools, and per pool and salt. ``df`` is read twice, the first time by id and source only.
    """
    weights = {OTHERS: 1, **weights}
    if any(w != int(w) or w < 1 for w in weights.values()):
        raise ValueError("weights must be positive whole numbers")
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pool = F.coalesce(F.col(source_col).cast("string"), F.lit(OTHERS))
    key = F.xxhash64(F.col(id_col))
    salt = F.pmod(key, F.lit(SALTS)).cast("int")
    counts = materialise(df.select(pool.alias("mix_pool"), salt.alias("_salt")).groupBy("mix_pool", "_salt").agg(F.count("*").alias("_n")), "pool-salts")
    totals = counts.groupBy("mix_pool").agg(F.sum("_n").alias("n")).orderBy("mix_pool")
    rows = {r.mix_pool: r.n for r in totals.limit(MAX_POOLS + 1).collect()}
    if len(rows) > MAX_POOLS:
        raise ValueError(f"more than {MAX_POOLS} sources; map them to fewer before mixing")
    weights = {name: weights.get(name, weights[OTHERS]) for name in rows}
    plan = phases({name: -(-n // block) for name, n in rows.items()}, weights)
    table = F.broadcast(spark.createDataFrame(plan, "mix_pool string, _first long, _end long, _start long, _period long, _slots array<long>"))
    # A pool's last block is short by some rows; blocks behind it move up by as many.
    short = []
    for name, first, end, start, length, slots in plan:
        lacking = -rows[name] % block
        if lacking and end == -(-rows[name] // block) and end > first:
            turns, at = divmod(end - 1 - first, len(slots))
            short.append((start + turns * length + slots[at], lacking))

    def placed(ranked: DataFrame) -> DataFrame:
        """Add block, slot and position of the row with ``_rank`` in its pool."""
        dealt = ranked.withColumn("mix_block", F.floor(F.col("_rank") / block)).join(table, "mix_pool").where("mix_block >= _first AND mix_block < _end")
        turn = F.col("mix_block") - F.col("_first")
        within = F.element_at("_slots", (turn % F.size("_slots") + 1).cast("int"))
        dealt = dealt.withColumn("mix_slot", F.col("_start") + F.floor(turn / F.size("_slots")) * F.col("_period") + within)
        missing = F.lit(0).cast("long")
        for slot, lacking in short:
            missing = missing + F.when(F.col("mix_slot") > slot, F.lit(lacking)).otherwise(F.lit(0))
        return dealt.withColumn("mix_position", (F.col("mix_slot") * block + F.col("_rank") % block - missing).cast("long"))

    before = Window.partitionBy("mix_pool").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("mix_pool", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rank"))
    part = F.floor(F.col("mix_position") * parts / max(sum(rows.values()), 1)).cast("int")
    starts = placed(starts).select("mix_pool", "_salt", F.col("_rank").alias("_before"), part.alias("_part"))
    # The row goes along as one value, so that no column of it clashes with those made here.
    row = F.struct(*[c for c in df.columns if c not in MIX_COLUMNS]).alias("_row")
    packed = df.select(row, F.col(id_col).alias("_id"), pool.alias("mix_pool"), salt.alias("_salt"), key.alias("_key"))
    salted = packed.join(F.broadcast(starts), ["mix_pool", "_salt"])
    within = Window.partitionBy("_part", "mix_pool", "_salt").orderBy("_key", "_id")
    moved = salted.repartitionById(parts, F.col("_part"))
    ranked = moved.withColumn("_rank", F.col("_before") + F.row_number().over(within) - 1)
    return placed(ranked).select("_row.*", *MIX_COLUMNS)


def mixed_order(df: DataFrame, weights: Mapping[str, int], **options) -> DataFrame:
    """The rows of ``df`` in mixed order: the files of a written result, and the rows in them, follow one another exactly
    as the schedule takes them. The rows move once more than in ``mix_sources``, and ``df`` is counted before."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.col("mix_position") * parts / max(df.count(), 1)).cast("int")
    placed = mix_sources(df, weights, **options).repartitionById(parts, part)
    return placed.sortWithinPartitions("mix_position").select(*[c for c in df.columns if c not in MIX_COLUMNS])
