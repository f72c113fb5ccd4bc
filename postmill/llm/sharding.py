"""Balanced label propagation: linked documents move towards their neighbours' shards under capacity quotas.

Links are given by hubs: documents that share a hub are linked with one another, so a group of m copies is m rows and
never its pairs. Every document starts with a label, a shard it is dealt to by hash. Copies see the same neighbours, so
they move together: in a round every hub that still moves asks for the shard most of its labels are in, among those
with room for all of it, and each shard grants what it is asked for, largest hubs first, as long as whole hubs fit. A
hub that got nothing asks for its next shard; there is no bound on rounds, they end when nobody can be granted anything.
Only documents whose hub was granted hold places. Documents without links take the places left at the end.

What is split, and why it is few: a hub with more rows than a shard fills whole shards and moves on with its rest. When
the rounds end, every hub without a shard is larger than any room left, and all rooms together hold all such hubs, so
there are fewer of them than shards. These alone are cut, into as few pieces as the rooms allow.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import materialise, salted_rank
from postmill.sources.scratch import scratch_path

#: Rows are numbered in pieces of about so many rows, in 64 pieces at least.
PIECE_ROWS = 1_000_000
#: Hubs with this share of all linked rows or more, of which there are at most as many, are joined by broadcast.
HEAVY = 1_024
PIECES = "hub long, lo long, hi long, shard int"

Piece = tuple[int, int, int, int]


def salts_of(rows: int) -> int:
    return max(64, rows // PIECE_ROWS)


@dataclass(frozen=True)
class Quotas:
    """Rows per shard that differ by at most one; the first shards take the rest."""

    rows: int
    shards: int

    def sizes(self) -> np.ndarray:
        return self.rows // self.shards + (np.arange(self.shards) < self.rows % self.shards)


def fill_whole(giants: Sequence[tuple[int, int]], room: np.ndarray) -> tuple[list[Piece], list[tuple[int, int, int]]]:
    """Pieces ``(hub, lo, hi, shard)`` of hubs ``(hub, n)`` that fill whole empty shards, and rests ``(hub, n, lo)``.

    ``room`` is the size of every shard, all empty, and is reduced.
    """
    pieces, rests = [], []
    empty = [int(j) for j in np.argsort(-room, kind="stable") if room[j]]
    for hub, n in sorted(giants, key=lambda g: (-g[1], g[0])):
        lo = 0
        for j in list(empty):
            if n - lo >= room[j]:
                pieces.append((hub, lo, lo + int(room[j]), j))
                lo += int(room[j])
                room[j] = 0
                empty.remove(j)
        if lo < n:
            rests.append((hub, n - lo, lo))
    return pieces, rests


def cut(hubs: Sequence[tuple[int, int, int]], room: np.ndarray) -> list[Piece]:
    """Pieces of hubs ``(hub, n, lo)`` that no room holds whole: the largest room each, and for a rest that fits
    somewhere the smallest room that holds it. ``room`` is reduced; it must hold all of them together."""
    pieces = []
    for hub, n, lo in sorted(hubs, key=lambda h: (-h[1], h[0])):
        while n:
            holds = np.flatnonzero(room >= n)
            j = int(holds[np.argmin(room[holds])]) if holds.size else int(np.argmax(room))
            part = int(min(n, room[j]))
            pieces.append((hub, lo, lo + part, j))
            room[j] -= part
            n, lo = n - part, lo + part
    return pieces


def _in_turn(rank: Column, free: np.ndarray) -> Column:
    """Shard of the row with ``rank``: shards with free places take turns until theirs are used up."""
    shard, start, below = F.lit(None).cast("int"), 0, 0
    turns = []
    for level in sorted(set(int(f) for f in free if f > 0)):
        takers = [i for i, f in enumerate(free) if f >= level]
        end = start + (level - below) * len(takers)
        taker = F.element_at(F.array(*[F.lit(i) for i in takers]), (F.pmod(rank - start, F.lit(len(takers))) + 1).cast("int"))
        turns.append((end, taker))
        start, below = end, level
    for end, taker in reversed(turns):
        shard = F.when(rank < end, taker).otherwise(shard)
    return shard


def _ask(room: np.ndarray, turn: int) -> Column:
    """The shard a hub asks for: the first of its ``homes`` with room for all of it, or one of the others with that much
    room, drawn by hash in proportion to it. NULL where there is none."""
    rooms = F.array(*[F.lit(int(r)).cast("long") for r in room])
    home = F.get(F.filter("homes", lambda s: F.get(rooms, s) >= F.col("n")), F.lit(0))
    fitting = F.filter(F.array(*[F.lit(j) for j in range(len(room))]), lambda s: F.get(rooms, s) >= F.col("n"))
    draw = lambda s: (F.pmod(F.xxhash64("hub", F.lit(turn), s), F.lit(2**52)) + 1) / F.lit(float(2**52 + 1))
    drawn = F.array_min(F.transform(fitting, lambda s: F.struct((-F.log(draw(s)) / F.get(rooms, s)).alias("key"), s.alias("shard"))))["shard"]
    return F.coalesce(home, drawn)


def propagate(linked: DataFrame, sizes: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """``(hub, lo, hi, shard)``: where the rows ``lo`` to ``hi - 1`` of a hub go, and the room that is left.

    ``linked`` is a written table ``(hub, row_key)``, the keys gapless from 0 within a hub. One row per hub moves. Who is
    granted what follows from the number of hubs of each size that ask for a shard: at most the square root of twice
    the rows of a shard are in its window. The driver sees one number per shard and round, and fewer hubs than shards.
    """
    spark, shards = linked.sparkSession, len(sizes)
    label = F.pmod(F.xxhash64("hub", "row_key"), F.lit(shards)).cast("int")
    tally = linked.groupBy("hub", label.alias("shard")).agg(F.count("*").alias("n"))
    place = F.struct((-F.col("n")).alias("n"), F.xxhash64("hub", "shard").alias("tie"), "shard")
    homes = F.transform(F.array_sort(F.collect_list(place)), lambda h: h["shard"])
    hubs = materialise(tally.groupBy("hub").agg(F.sum("n").alias("n"), homes.alias("homes")), "hubs")

    room = np.array(sizes, dtype=np.int64)
    largest = int(room.max(initial=0))
    giants = [(r.hub, r.n) for r in hubs.where(F.col("n") > largest).select("hub", "n").collect()]  # fewer than shards
    pieces, rests = fill_whole(giants, room)
    folder = scratch_path(spark, "granted")
    rest = spark.createDataFrame([(hub, n, lo, []) for hub, n, lo in rests], "hub long, n long, lo long, homes array<int>")
    asking = hubs.where(F.col("n") <= largest).select("hub", "n", F.lit(0).cast("long").alias("lo"), "homes").unionByName(rest)
    salts = salts_of(int(room.sum()))
    turn = 0
    while True:
        asked = asking.withColumn("shard", _ask(room, turn))
        demand = asked.where("shard IS NOT NULL").groupBy("shard", "n").agg(F.count("*").alias("_hubs"))
        larger = Window.partitionBy("shard").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
        ahead = F.coalesce(F.sum(F.col("_hubs") * F.col("n")).over(larger), F.lit(0))
        left = F.get(F.array(*[F.lit(int(r)).cast("long") for r in room]), F.col("shard")) - ahead
        fits = F.greatest(F.least(F.col("_hubs"), F.floor(left / F.col("n"))), F.lit(0))
        grants = materialise(demand.select("shard", "n", fits.cast("long").alias("_fits")).where("_fits > 0"), "grants")
        moved = grants.groupBy("shard").agg(F.sum(F.col("_fits") * F.col("n")).alias("rows")).collect()
        if not moved:
            break
        salt = F.pmod(F.xxhash64("hub", F.lit(turn)), F.lit(salts)).cast("int")
        ranked = salted_rank(asked, ["shard", "n"], salt, ["hub"], "_rank", salts)
        decided = ranked.join(grants, ["shard", "n"], "left").withColumn("_granted", F.coalesce(F.col("_rank") < F.col("_fits"), F.lit(False)))
        decided = materialise(decided.select("hub", "n", "lo", "homes", "shard", "_granted"), "decided")
        granted = decided.where("_granted").select("hub", "lo", (F.col("lo") + F.col("n")).alias("hi"), "shard")
        granted.write.parquet(f"{folder}/turn={turn}")
        asking = decided.where("NOT _granted").select("hub", "n", "lo", "homes")
        for row in moved:
            room[row.shard] -= row.rows
        turn += 1
    pieces += cut([(r.hub, r.n, r.lo) for r in asking.select("hub", "n", "lo").collect()], room)  # fewer than shards
    spark.createDataFrame(pieces, PIECES).write.parquet(f"{folder}/turn={turn}")
    return spark.read.schema(PIECES).parquet(folder).select("hub", "lo", "hi", "shard"), room


def _by_hub(rows: DataFrame, table: DataFrame, heavy: DataFrame, on: Column | None = None, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` by hub, rows of ``heavy`` hubs by broadcast, so that no task gets all rows of one."""

    def join(part: DataFrame, other: DataFrame) -> DataFrame:
        same = F.col("hub") == F.col("_hub")
        return part.join(other.withColumnRenamed("hub", "_hub"), same if on is None else same & on, how).drop("_hub")

    heavy = F.broadcast(heavy)
    light = join(rows.join(heavy, "hub", "left_anti"), table)
    return light.unionByName(join(rows.join(heavy, "hub", "left_semi"), F.broadcast(table.join(heavy, "hub", "left_semi"))))


def shard_documents(
    df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None
) -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` for every row; documents with equal texts are linked.

    Law: the numbers of rows of any two shards differ by at most one. Under it, copies of a text share a shard; texts
    with more copies than a shard holds, and fewer texts than there are shards for which no shard had room, are cut.
    ``size`` is the number of UTF-8 bytes plus 8, ``slot``
    numbers the rows of a shard from 0 without gaps. A NULL text counts as empty and is linked with empty ones.
    Repeated rows, NULL ids among them, are rows like others and each get a slot. Other columns are not read. An empty
    table gives an empty result.

    ``order_col`` holds the place of a row in an order of the whole table, from 0. With it documents without links go to
    the shards in turn in that order, and the slots of every shard follow it; without it both follow a hash of the id.
    """
    given = [] if order_col is None else ["_place"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    nodes = materialise(
        df.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text, F.octet_length(text)).alias("hub"),
            *[F.coalesce(F.col(order_col), F.lit(2**62)).cast("long").alias(name) for name in given],
        ),
        "nodes",
    )
    n_rows = nodes.count()
    sizes, salts = Quotas(n_rows, shards).sizes(), salts_of(n_rows)
    counts = nodes.groupBy("hub").agg(F.count("*").alias("_n"))
    hubs = materialise(counts.where("_n > 1"), "shared-hubs")
    heavy = hubs.where(F.col("_n") * HEAVY >= n_rows).select("hub")
    marked = _by_hub(nodes, hubs, heavy, how="left").withColumn("_linked", F.col("_n").isNotNull()).drop("_n")
    marked = materialise(marked, "marked")
    # Rows of a hub agree in all but the id, so a number within the hub tells them apart.
    linked = materialise(
        salted_rank(marked.where("_linked"), ["hub"], F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"), ["id"], "row_key", salts),
        "linked",
    )
    homes, free = propagate(linked.select("hub", "row_key"), sizes)
    columns = ["id", "size", "text_crc32", "shard", *given]
    placed = _by_hub(linked, homes, heavy, (F.col("row_key") >= F.col("lo")) & (F.col("row_key") < F.col("hi"))).select(*columns)
    if given:  # salts in the given order, so that ranks follow it
        salt = F.least(F.floor(F.col("_place") * salts / max(n_rows, 1)), F.lit(salts - 1)).cast("int")
        place = _in_turn(F.col("_rank"), free)
    else:
        salt = F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")
        ends = F.array(*[F.lit(int(x)).cast("long") for x in np.cumsum(free)])
        place = F.size(F.filter(ends, lambda end: end <= F.col("_rank")))
    others = salted_rank(marked.where("not _linked"), [], salt, [*given, "id", "hub"], "_rank", salts)
    filled = others.withColumn("shard", place).select(*columns)
    shards_of = materialise(placed.unionByName(filled), "placed")
    return salted_rank(shards_of, ["shard"], salt, [*given, "id", "text_crc32"], "slot", salts).drop(*given)
