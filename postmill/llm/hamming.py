"""Exact nearest neighbours of binary codes by incremental multi-index hashing.

A code is cut into m chunks and indexed once per chunk. In step r a query probes, in every chunk, the values at exactly
r flipped bits; a code not found by then differs in more than r bits in every chunk, so in m (r + 1) bits at least. A
query is finished once its k-th verified distance is below that, ties included. In every step probes and index entries
of all chunks meet in one exchange; a task verifies what meets there and lets out no more than the k best per query, and
none beyond the k-th distance known by then, at first that to a few sampled codes.
When a step would probe more values than there are codes, what is left is compared with all codes in a grid of query
blocks and shares of the codes, which is exact as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import materialise

BITS = 64
SALTS = 256
SCAN_QUERIES = 16_384  # queries a task holds while codes stream past them
SCAN_CODES = 16_777_216  # codes that stream past them
HOT_ENTRIES = 100_000  # index entries of one value that a task takes; more are dealt to several
HELD = 1 << 20  # found pairs a task holds before it cuts them to the best
PAIRS = 1 << 20  # pairs verified at once
SAMPLE = 256  # codes whose k-th distance bounds a query's result from the start


def sign_code(vector: str, bits: int = BITS) -> Column:
    """A bit per positive entry; NULL unless the vector has ``bits`` entries. NULL and NaN entries give 0."""
    entries = f"transform(`{vector}`, (x, i) -> IF(x > 0 AND NOT isnan(x), shiftleft(1L, i), 0L))"
    return F.expr(f"IF(size(`{vector}`) = {bits}, aggregate({entries}, 0L, (a, b) -> a | b), NULL)")


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def chunk_bits(chunks: int) -> list[range]:
    cuts = [round(i * BITS / chunks) for i in range(chunks + 1)]
    return [range(a, b) for a, b in zip(cuts, cuts[1:])]


def _mask(bits: range) -> int:
    return _signed(sum(1 << b for b in bits))


class Nearest:
    """The ``k`` nearest codes of every query met so far, ties by the lowest id."""

    names = ("query_id", "query_code", "code", "lowest", "n_ids", "distance")

    def __init__(self, k: int) -> None:
        self.k, self.held, self.size, self.most = k, [], 0, HELD

    def add(self, *columns: np.ndarray) -> None:
        self.held.append(columns)
        self.size += len(columns[0])
        if self.size > self.most:
            self.cut()
            self.most = max(HELD, 2 * self.size)

    def cut(self) -> tuple[np.ndarray, ...]:
        found = tuple(np.concatenate(column) for column in zip(*self.held))
        id_, code, _, lowest, _, distance = found
        order = np.lexsort((lowest, distance, code, id_))
        id_, code = id_[order], code[order]
        start = np.flatnonzero(np.append(True, (id_[1:] != id_[:-1]) | (code[1:] != code[:-1])))
        rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
        found = tuple(column[order[rank < self.k]] for column in found)
        self.held, self.size = [found], len(found[0])
        return found

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in self.cut()], names=list(self.names))


FOUND = ", ".join(f"{name} long" for name in Nearest.names)


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(name).to_numpy(zero_copy_only=False) for name in names]


def _probes(queries: DataFrame, cuts: list[range], flips: int) -> DataFrame:
    """``(chunk, value, query_id, query_code, bound)``: every value of a chunk, its bits in place, at exactly ``flips`` flipped ones."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_, code, bound = _columns(batch, "query_id", "query_code", "bound")
            for chunk, bits in enumerate(cuts):
                masks = np.array([_signed(sum(1 << b for b in flipped)) for flipped in combinations(bits, flips)], dtype=np.int64)
                step = max(1, PAIRS // max(len(masks), 1))
                for lo in range(0, len(id_) if len(masks) else 0, step):
                    value = ((code[lo : lo + step, None] & _mask(bits)) ^ masks).ravel()
                    repeated = [pa.array(np.repeat(x[lo : lo + step], len(masks))) for x in (id_, code, bound)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), chunk, np.int32)), pa.array(value), *repeated], names=["chunk", "value", "query_id", "query_code", "bound"])

    return queries.select("query_id", "query_code", "bound").mapInArrow(probe, "chunk int, value long, query_id long, query_code long, bound long")


def _bounded(queries: DataFrame, codes: DataFrame, k: int) -> DataFrame:
    """Queries with ``bound``: no result is farther, as ``k`` codes of a sample of 256 are as near."""
    sample = [row.code for row in codes.select("code").orderBy(F.xxhash64("code"), "code").limit(max(SAMPLE, k)).collect()]
    if len(sample) < k:
        return queries.withColumn("bound", F.lit(BITS).cast("long"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array(sample, dtype=np.int64)
        for batch in batches:
            code, found = _columns(batch, "query_code")[0], np.empty(batch.num_rows, dtype=np.int64)
            for lo in range(0, len(code), 1_024):
                apart = np.bitwise_count((code[lo : lo + 1_024, None] ^ known).view(np.uint64))
                found[lo : lo + 1_024] = np.partition(apart, k - 1, axis=1)[:, k - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=["query_id", "query_code", "bound"])

    return queries.select("query_id", "query_code").mapInArrow(bound, "query_id long, query_code long, bound long")


def _found_first(xor: np.ndarray, chunk: int, cuts: list[range], flips: int) -> np.ndarray:
    """Whether no earlier step, and no earlier chunk of this step, has found the code."""
    first = np.ones(len(xor), dtype=bool)
    for other, bits in enumerate(cuts):
        apart = np.bitwise_count((xor & _mask(bits)).view(np.uint64))
        if other == chunk:
            continue
        first &= (apart > flips) | ((other > chunk) & (apart == flips))
    return first


def _verified(cuts: list[range], flips: int, k: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (chunk, value, piece); of a key the probes come before the entries."""
        nearest = Nearest(k)
        key, open_ = None, []  # the key whose probes are open, and they

        for batch in batches:
            chunk, value, piece, side = _columns(batch, "chunk", "value", "piece", "side")
            id_, query, bound, code, lowest, n_ids = _columns(batch, "query_id", "query_code", "bound", "code", "lowest", "n_ids")
            change = (chunk[1:] != chunk[:-1]) | (value[1:] != value[:-1]) | (piece[1:] != piece[:-1])
            start = np.concatenate([[0], np.flatnonzero(change) + 1, [len(chunk)]]) if len(chunk) else np.zeros(1, dtype=np.int64)
            middle = start[:-1] + np.array([np.count_nonzero(side[a:b] == 0) for a, b in zip(start[:-1], start[1:])], dtype=np.int64)
            for lo, mid, hi in zip(start[:-1].tolist(), middle.tolist(), start[1:].tolist()):
                own = (chunk[lo], value[lo], piece[lo])
                if own != key:
                    key, open_ = own, []
                if mid > lo:
                    open_.append((id_[lo:mid], query[lo:mid], bound[lo:mid]))
                if hi == mid or not open_:
                    continue
                if len(open_) > 1:
                    open_ = [tuple(np.concatenate(column) for column in zip(*open_))]
                ids, queries, bounds = open_[0]
                step = max(1, PAIRS // len(ids))
                for at in range(mid, hi, step):
                    entry = code[at : min(at + step, hi)]
                    xor = queries[:, None] ^ entry
                    apart = np.bitwise_count(xor.view(np.uint64)).astype(np.int64)
                    q, e = np.nonzero(apart <= bounds[:, None])
                    first = _found_first(xor[q, e], own[0], cuts, flips)
                    q, e = q[first], e[first]
                    if len(q):
                        nearest.add(ids[q], queries[q], entry[e], lowest[at + e], n_ids[at + e], apart[q, e])
        yield from nearest.batches()

    return verify


def _step(active: DataFrame, index: DataFrame, hot: DataFrame | None, cuts: list[range], flips: int, k: int) -> DataFrame:
    """What a step finds: probes and index meet in one exchange, a value of very many codes in several pieces."""
    key = ["chunk", "value"]
    probes = _probes(active, cuts, flips).withColumns({"code": F.lit(0).cast("long"), "lowest": F.lit(0).cast("long"), "n_ids": F.lit(0).cast("long"), "side": F.lit(0)})
    entries = index.select(*key, F.lit(0).cast("long").alias("query_id"), F.lit(0).cast("long").alias("query_code"), F.lit(0).cast("long").alias("bound"), "code", "lowest", "n_ids", F.lit(1).alias("side"))
    if hot is None:
        both = probes.unionByName(entries).withColumn("piece", F.lit(0).cast("long"))
    else:
        # At most one hot value per HOT_ENTRIES index entries, so the table may be broadcast.
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_pieces", F.lit(1)) - 1)).alias("piece")
        own = F.coalesce(F.pmod(F.xxhash64("code"), F.col("_pieces")), F.lit(0)).alias("piece")
        both = probes.join(F.broadcast(hot), key, "left").select(*probes.columns, every)
        both = both.unionByName(entries.join(F.broadcast(hot), key, "left").select(*entries.columns, own))
    tasks = int(active.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(tasks, *key, "piece").sortWithinPartitions(*key, "piece", "side")
    return dealt.mapInArrow(_verified(cuts, flips, k), FOUND)


def _scan(queries: DataFrame, codes: DataFrame, sizes: tuple[int, int], k: int) -> DataFrame:
    """Compare all queries with all codes: blocks of queries are held while shares of the codes stream past them."""
    n_queries, n_codes = sizes
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = -(-n_queries // SCAN_QUERIES) or 1
    shares = max(-(-n_codes // SCAN_CODES), -(-tasks // blocks), 1)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest, held, ids, wanted, most = Nearest(k), [], None, None, None
        for batch in batches:
            n_own = int(np.count_nonzero(_columns(batch, "side")[0] == 0))
            if n_own:
                held.append([c.astype(np.int64) for c in _columns(batch.slice(0, n_own), "query_id", "query_code")])
            rest = batch.slice(n_own)
            if not rest.num_rows or not held:
                continue
            if ids is None:
                ids, wanted = (np.concatenate(column) for column in zip(*held))
                most = np.full(len(ids), BITS)
            code, lowest, n_ids = (c.astype(np.int64) for c in _columns(rest, "code", "lowest", "n_ids"))
            step = max(1, PAIRS // len(code))
            for lo in range(0, len(ids), step):
                apart = np.bitwise_count((wanted[lo : lo + step, None] ^ code).view(np.uint64))
                if len(code) > k:  # the k-th of these codes bounds the result; equal ones may win by their id
                    kth = np.partition(apart, k - 1, axis=1)[:, k - 1]
                    most[lo : lo + step] = np.minimum(most[lo : lo + step], kth)
                q, c = np.nonzero(apart <= most[lo : lo + step, None])
                nearest.add(ids[lo + q], wanted[lo + q], code[c], lowest[c], n_ids[c], apart[q, c].astype(np.int64))
        yield from nearest.batches()

    none = [F.lit(0).cast("long").alias(name) for name in ("query_id", "query_code", "code", "lowest", "n_ids")]
    block = F.pmod(F.xxhash64("query_id", "query_code"), F.lit(blocks)).cast("int") * shares
    share = F.pmod(F.xxhash64("code"), F.lit(shares)).cast("int")
    cell = F.explode(F.transform(F.sequence(F.lit(0), F.lit(shares - 1)), lambda i: block + i)).alias("cell")
    ours = queries.select("query_id", "query_code", *none[2:], F.lit(0).alias("side"), cell)
    cell = F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: i * shares + share)).alias("cell")
    theirs = codes.select(*none[:2], "code", "lowest", "n_ids", F.lit(1).alias("side"), cell)
    dealt = ours.unionByName(theirs).repartitionById(blocks * shares, F.col("cell")).sortWithinPartitions("cell", "side")
    return dealt.drop("cell").mapInArrow(near, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """Codes of every query in order of (distance, lowest id), as many as hold ``k`` ids."""
    before = Window.partitionBy("query_id", "query_code").orderBy("distance", "lowest").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("_before", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).where(F.col("_before") < k).select(*Nearest.names)


def distinct_codes(df: DataFrame, id_col: str, code: Column, k: int) -> DataFrame:
    """``(code, ids)``: distinct codes with their ``k`` lowest ids in order, which are all that a result of ``k`` can hold.

    A code held by a third of all rows is thinned in salted parts first.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), code.alias("code")).where("code IS NOT NULL AND id IS NOT NULL").distinct()
    part = Window.partitionBy("code", F.pmod(F.xxhash64("id"), F.lit(SALTS))).orderBy("id")
    thinned = rows.withColumn("_rank", F.row_number().over(part)).where(F.col("_rank") <= k)
    return thinned.groupBy("code").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k).alias("ids"))


def nearest_codes(codes: DataFrame, queries: DataFrame, k: int, chunks: int | None = None) -> DataFrame:
    """``(query_id, rank, id, distance)``: the ``k`` nearest ids of every query, ties by the lower id.

    ``codes`` is a written table ``(code, ids)`` of distinct codes, ``queries`` one ``(query_id, query_code)``; ids are
    longs. Fewer than ``k`` ids in all give as many rows. No codes or no queries give an empty result. Runs jobs.
    """
    n_codes = codes.count()
    total = min(k, codes.select(F.sum(F.size("ids"))).first()[0] or 0)
    if chunks is None:
        # As many chunks as leave a chunk no more values than there are codes, so that few probes are in vain.
        chunks = max(2, ceil(BITS / max(log2(max(n_codes, 2)), 4)))
    cuts = chunk_bits(chunks)
    small = codes.select("code", F.get("ids", F.lit(0)).alias("lowest"), F.size("ids").cast("long").alias("n_ids"))
    numbers = F.array(*[F.struct(F.lit(j).alias("chunk"), F.col("code").bitwiseAND(_mask(bits)).alias("value")) for j, bits in enumerate(cuts)])
    index = small.select(F.explode(numbers).alias("_entry"), "*").select("_entry.*", "code", "lowest", "n_ids")
    pieces = F.ceil(F.col("_n") / HOT_ENTRIES).alias("_pieces")
    hot = materialise(index.groupBy("chunk", "value").agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_ENTRIES).select("chunk", "value", pieces), "hot-values")
    hot = None if hot.isEmpty() else hot
    same = ["query_id", "query_code"]
    best, active, finished = None, materialise(_bounded(queries, codes, k), "active"), []
    for flips in range(max(map(len, cuts)) + 1):
        n_active = active.count()
        if not n_active:
            break
        if sum(comb(len(bits), flips) for bits in cuts) > n_codes:
            finished.append(materialise(_best(_scan(active, small, (n_active, n_codes), k), k), "scanned"))
            break
        step = _step(active, index, hot, cuts, flips, k)
        best = materialise(_best(step if best is None else step.unionByName(best), k), "nearest")
        state = best.groupBy(*same).agg(F.sum("n_ids").alias("_n"), F.max("distance").alias("_kth"))
        state = materialise(state.withColumn("_covered", (F.col("_n") >= total) & (F.col("_kth") < chunks * (flips + 1))), "state")
        covered = state.where("_covered").select(*same)
        finished.append(best.join(covered, same, "left_semi"))
        nearer = F.least("bound", F.when(F.col("_n") >= k, F.col("_kth"))).alias("bound")
        active = materialise(active.join(state, same, "left").where("_covered IS NOT TRUE").select(*same, nearer), "active")
        best = best.join(covered, same, "left_anti")
    if not finished:
        return queries.select("query_id", F.lit(0).alias("rank"), F.col("query_id").alias("id"), F.lit(0).cast("long").alias("distance")).limit(0)
    found = materialise(reduce(DataFrame.unionByName, [f.select("query_id", "query_code", "code", "distance") for f in finished]), "finished")
    rows = found.join(codes, "code").select("query_id", "query_code", F.explode("ids").alias("id"), "distance")
    order = Window.partitionBy("query_id", "query_code").orderBy("distance", "id")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "distance")


def search_vectors(df: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", chunks: int | None = None) -> DataFrame:
    """``(query_id, rank, id, distance)``: the rows nearest to every row for which ``is_query`` holds, itself included.

    Codes are the signs of the entries. Rows with a NULL id, a NULL vector or one of another length have no code: they
    are neither found nor searched for. Rows that repeat in id and code count once; an id with several codes is
    searched for and found under each. Ids are whole numbers. Other columns are not read. An empty table gives an empty result.
    """
    code = sign_code(vector_col)
    codes = materialise(distinct_codes(df, id_col, code, k), "codes")
    queries = df.where(is_query).select(F.col(id_col).cast("long").alias("query_id"), code.alias("query_code"))
    queries = materialise(queries.where("query_id IS NOT NULL AND query_code IS NOT NULL").distinct(), "queries")
    return nearest_codes(codes, queries, k, chunks)
