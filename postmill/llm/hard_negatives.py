"""Hard negatives by exact inner products, several candidates to a multiplication.

Components become whole numbers, biased so that none is negative. The components of several candidates are packed
into separated fields of one 64-bit integer, each field as wide as the largest possible product sum, so that one
multiplication per anchor component adds to the scores of all of them and no field runs into the next. The bias is then
taken out again, which leaves the exact inner products.

Anchors and candidates meet in a grid of cells. A cell holds a block of anchors and streams its share of the candidates
past them, keeping no more than the best few per anchor, so what leaves a cell is bounded by its anchors. The first pass
finds positives, the second the negatives in the bands that the positives set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from postmill.llm.common import materialise
from postmill.llm.ptolemy import is_finite, whole_components

ANCHORS = 65_536  # anchors a cell holds
CANDIDATES = 4_194_304  # candidates that stream past them
TILE = (128, 2_048)  # anchors and candidates multiplied at once
VALUES = 4_194_304  # components of candidates unpacked at once
MOST_BITS = 56  # of a field; scores times 100 must fit a long
ANY = 1 << 60


class Packing:
    """Fields for inner products of ``width`` components between ``low`` and ``high``."""

    def __init__(self, low: int, high: int, width: int) -> None:
        self.bias = max(-low, 0)
        self.bits = max((max(high, 0) + self.bias) ** 2 * max(width, 1), 1).bit_length()
        if self.bits > MOST_BITS:
            raise ArithmeticError(f"inner products of {width} components between {low} and {high} need {self.bits} bits, over {MOST_BITS}")
        self.fields = 64 // self.bits

    def pack(self, candidates: np.ndarray) -> np.ndarray:
        """Rows of components to words, one row per component: candidate ``w + i * words`` is field ``i`` of word ``w``."""
        words = -(-len(candidates) // self.fields)
        out = np.zeros((candidates.shape[1], words), dtype=np.uint64)
        for field in range(self.fields):
            part = (candidates[field * words : (field + 1) * words].T + self.bias).astype(np.uint64)
            out[:, : part.shape[1]] |= part << np.uint64(field * self.bits)
        return out

    def scores(self, anchors: np.ndarray, packed: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Exact inner products of every anchor with the packed candidates, which are given once more for their sums."""
        biased = (anchors + self.bias).astype(np.uint64)
        total, product = np.zeros((len(anchors), packed.shape[1]), dtype=np.uint64), np.empty((len(anchors), packed.shape[1]), dtype=np.uint64)
        for component, word in enumerate(packed):
            np.multiply(biased[:, component, None], word, out=product)
            total += product
        mask = np.uint64((1 << self.bits) - 1)
        fields = [(total >> np.uint64(i * self.bits)) & mask for i in range(self.fields)]
        out = np.concatenate(fields, axis=1)[:, : len(candidates)].astype(np.int64)
        out -= self.bias * anchors.sum(axis=1)[:, None]
        out -= self.bias * candidates.sum(axis=1) + anchors.shape[1] * self.bias**2
        return out


class Rows:
    """Ids, keys, labels and vectors of different lengths, which count as filled up with zeros."""

    def __init__(self, batch: pa.RecordBatch | pa.Table) -> None:
        column = {name: batch.column(name) for name in ("id", "row", "label", "vector")}
        self.id, self.row, self.label = (column[n].to_numpy(zero_copy_only=False) if isinstance(column[n], pa.Array) else column[n].to_numpy() for n in ("id", "row", "label"))
        vectors = column["vector"] if isinstance(column["vector"], pa.Array) else column["vector"].combine_chunks()
        self.values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.ends = np.append(0, np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False)))

    def __len__(self) -> int:
        return len(self.id)

    def width(self) -> int:
        return int(np.diff(self.ends).max(initial=0))

    def matrix(self, lo: int, hi: int, width: int) -> np.ndarray:
        """The first ``width`` components of rows ``lo`` to ``hi``."""
        lengths = np.diff(self.ends[lo : hi + 1])
        if (lengths == width).all():
            return self.values[self.ends[lo] : self.ends[hi]].reshape(hi - lo, width)
        out = np.zeros((hi - lo, width), dtype=np.int64)
        for i, (start, length) in enumerate(zip(self.ends[lo:hi], np.minimum(lengths, width))):
            out[i, :length] = self.values[start : start + length]
        return out


class Best:
    """The ``k`` best candidates of every slot, a slot being one band of scores of one anchor."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int) -> None:
        self.low, self.high, self.k = low, high, k  # both (anchors, bands)
        self.found = tuple(np.empty(0, dtype=np.int64) for _ in range(4))  # slot, score, id, row

    def offer(self, slot: np.ndarray, score: np.ndarray, id_: np.ndarray, row: np.ndarray) -> None:
        """Candidates come in ascending order of (id, row), so a full slot only takes in higher scores from then on."""
        slot, score, id_, row = (np.concatenate(pair) for pair in zip(self.found, (slot, score, id_, row)))
        order = np.lexsort((row, id_, -score, slot))
        slot = slot[order]
        start = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else np.empty(0, dtype=np.int64)
        rank = np.arange(len(slot)) - np.repeat(start, np.diff(np.append(start, len(slot))))
        kept = order[rank < self.k]
        full = order[rank == self.k - 1]
        self.low.ravel()[slot[rank == self.k - 1]] = score[full] + 1
        self.found = slot[rank < self.k], score[kept], id_[kept], row[kept]


def _cells(packing: Packing, same_label: bool, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one cell: its anchors, then its candidates by id."""
        held: list[pa.RecordBatch] = []
        anchors = best = None

        def meet(candidates: Rows) -> None:
            width = min(anchors.width(), candidates.width())
            step = max(1, min(TILE[1], VALUES // max(width, 1)))
            for lo in range(0, len(candidates), step):
                hi = min(lo + step, len(candidates))
                matrix = candidates.matrix(lo, hi, width)
                packed, offers = packing.pack(matrix), []
                label, id_, row = candidates.label[lo:hi], candidates.id[lo:hi], candidates.row[lo:hi]
                for first in range(0, len(anchors), TILE[0]):
                    last = min(first + TILE[0], len(anchors))
                    scores = packing.scores(anchors.matrix(first, last, width), packed, matrix)
                    fits = (anchors.label[first:last, None] == label) == same_label
                    if same_label:
                        fits &= (anchors.id[first:last, None] != id_) | (anchors.row[first:last, None] != row)
                    scores[~fits] = -2 * ANY
                    for band in range(best.low.shape[1]):
                        a, c = np.nonzero((scores >= best.low[first:last, band, None]) & (scores <= best.high[first:last, band, None]))
                        if len(a):
                            offers.append(((first + a) * best.low.shape[1] + band, scores[a, c], id_[c], row[c]))
                if offers:
                    best.offer(*(np.concatenate(column) for column in zip(*offers)))

        for batch in batches:
            n_anchors = int(np.count_nonzero(batch.column("side").to_numpy(zero_copy_only=False) == 0))
            if n_anchors:
                held.append(batch.slice(0, n_anchors))
            if n_anchors < batch.num_rows and held:
                if anchors is None:
                    table = pa.Table.from_batches(held)
                    anchors = Rows(table)
                    low, high = (np.array(table.column(n).combine_chunks().flatten()).reshape(len(anchors), -1) for n in ("low", "high"))
                    best = Best(low.copy(), high, k)
                meet(Rows(batch.slice(n_anchors)))
        if best is not None and len(best.found[0]):
            slot, score, id_, row = best.found
            anchor, band = np.divmod(slot, best.low.shape[1])
            columns = [anchors.id[anchor], anchors.row[anchor], band.astype(np.int32), id_, row, score]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "anchor_row", "band", "id", "row", "score"])

    return search


def _search(anchors: DataFrame, candidates: DataFrame, sizes: tuple[int, int], packing: Packing, same_label: bool, k: int) -> DataFrame:
    """The ``k`` best of every cell for every anchor and band. ``anchors`` has candidates' columns and ``low``, ``high``.

    The shorter the lists of cells, the fewer copies: an anchor goes to one cell per share of candidates, a candidate to
    one per block of anchors, and there are as many shares as tasks at least.
    """
    n_anchors, n_candidates = sizes
    blocks = -(-n_anchors // ANCHORS) or 1
    tasks = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = max(-(-n_candidates // CANDIDATES), -(-tasks // blocks), 1)
    key = F.xxhash64("id", "row")
    cell = F.pmod(key, F.lit(blocks)).cast("int") * shares
    left = anchors.select("*", F.lit(0).alias("side"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(shares - 1)), lambda i: cell + i)).alias("cell"))
    share = F.pmod(F.shiftright(key, 20), F.lit(shares)).cast("int")
    right = candidates.select("*", F.lit(1).alias("side"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: i * shares + share)).alias("cell"))
    dealt = left.unionByName(right, allowMissingColumns=True).repartitionById(blocks * shares, F.col("cell"))
    ordered = dealt.sortWithinPartitions("cell", "side", "id", "row").drop("cell")
    return ordered.mapInArrow(_cells(packing, same_label, k), "anchor_id long, anchor_row long, band int, id long, row long, score long")


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_negatives(
    df: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 3,
    band: tuple[int, int] = (50, 95),
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    A row's score is the inner product of its components, as whole numbers ``floor(256 x)``, with the anchor's; higher
    scores come first, ties by the smaller id. An anchor's positives are its first rows of the same label, itself left
    out; for each of them come the first rows of another label whose score is between ``band[0]`` and ``band[1]`` per
    cent of the positive's. Fewer than asked for are all there are; a positive without such rows has no row here.

    Rows with a NULL id, label or vector, or with a NULL, NaN or infinite component, take no part. Vectors of different
    lengths are multiplied over the components both have. Rows that agree in id, label and vector count once; rows
    that share only the id are rows of their own. Ids are whole numbers; labels may be of any type. ``is_anchor`` is a
    condition on the columns of ``df``, NULL counts as false; other columns are not read. An empty table, or one without
    anchors, gives an empty result. Raises ``ArithmeticError`` where products need more than 56 bits. Runs jobs.
    """
    kept = df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & is_finite(F.col(vector_col)))
    # Labels that are not whole numbers travel as a digest of 64 bits.
    label = F.col(label_col).cast("long") if isinstance(df.schema[label_col].dataType, IntegralType) else F.xxhash64(label_col)
    whole = kept.select(
        F.col(id_col).cast("long").alias("id"),
        label.alias("label"),
        whole_components(F.col(vector_col)).alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    )
    rows = whole.groupBy("id", "label", "vector").agg(F.max("is_anchor").alias("is_anchor"))
    rows = materialise(rows.withColumn("row", F.xxhash64("id", "label", "vector")), "candidates")
    size = rows.agg(
        F.count("*").alias("n"),
        F.count_if("is_anchor").alias("anchors"),
        F.max(F.size("vector")).alias("width"),
        F.min(F.array_min("vector")).alias("low"),
        F.max(F.array_max("vector")).alias("high"),
    ).first()
    packing = Packing(size.low or 0, size.high or 0, size.width or 0)
    candidates = rows.select("id", "row", "label", "vector")
    anchors = rows.where("is_anchor").select("id", "row", "label", "vector")
    sizes = (size.anchors, size.n)

    every = [F.array(F.lit(x).cast("long")).alias(n) for n, x in (("low", -ANY), ("high", ANY))]
    near = _search(anchors.select("*", *every), candidates, sizes, packing, True, positives)
    near = materialise(_ranked(near, ["anchor_id", "anchor_row"], positives), "positives")
    # A negative score has no band: its upper end lies below its lower one.
    low = F.expr(f"transform(near, p -> if(p.score < 0, {ANY}L, (p.score * {band[0]} + 99) div 100))").alias("low")
    high = F.expr(f"transform(near, p -> if(p.score < 0, -{ANY}L, p.score * {band[1]} div 100))").alias("high")
    filled = F.expr(f"transform(sequence(1, {positives}), i -> get(near, i - 1))")  # as many bands for every anchor
    bands = near.groupBy(F.col("anchor_id").alias("id"), F.col("anchor_row").alias("row")).agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("near"))
    bands = bands.select("id", "row", filled.alias("near")).select("id", "row", *[F.transform(c, lambda x: F.coalesce(x, F.lit(e).cast("long"))).alias(n) for c, n, e in ((low, "low", ANY), (high, "high", -ANY))])
    far = _search(anchors.join(bands, ["id", "row"]), candidates, sizes, packing, False, negatives)
    far = _ranked(far, ["anchor_id", "anchor_row", "band"], negatives)
    positive = near.select("anchor_id", "anchor_row", (F.col("rank") - 1).alias("band"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    joined = far.join(positive, ["anchor_id", "anchor_row", "band"])
    return joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
