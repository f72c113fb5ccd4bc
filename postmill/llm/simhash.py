"""Near duplicates by SimHash fingerprints and a hierarchical index over their Gray order.

Fingerprints that differ in at most ``d`` of 64 bits agree in ``b - d`` of any ``b`` bands, so for each choice of
``b - d`` bands the distinct fingerprints are grouped by the bits of these bands: every link lies inside a group.
Inside a group they are sorted by Gray rank, which puts fingerprints with shared bits side by side. Runs of eight
become nodes that hold the bits all members agree in, runs of eight nodes become upper nodes, and bits an upper node
holds are taken out of the nodes below it. A search adds up differences from the top and leaves a subtree as soon as
they exceed ``d``, or if the subtree is already connected with the query. A group yields a spanning forest, never its
pairs, and the forests of all groups meet in one connected-components run.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import materialise
from postmill.operators.components import connected_components

BITS = 64
SEED = 42
FAN_OUT = 8
HASH_BLOCK = 65_536  # hashes whose bits are counted at once
BLOCK_ROWS = 20_000  # fingerprints of a group searched in one piece; larger groups are cut and their pieces paired
WINDOW_ROWS = 100_000  # fingerprints a task gathers before it searches
FRONTIER = 2_000_000  # open (query, node) pairs before a run of queries is halved
GROUP_ROWS = 4_096  # mean size of a group above which one more band is cut


def fingerprint(text: str, width: int, seed: int = SEED) -> int:
    """A bit is set if it is set in over half of the hashes of the text's word shingles; 0 for a text without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    last = max(len(words) - width, 0)
    hash64 = xxhash.xxh64_intdigest
    spans = zip(starts[: last + 1].tolist(), ends[min(width, len(words)) - 1 :].tolist())
    hashes = np.array([hash64(joined[a:b], seed) for a, b in spans], dtype=">u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, len(hashes), HASH_BLOCK):
        counts += np.unpackbits(hashes[lo : lo + HASH_BLOCK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">i8")[0])


def add_fingerprints(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``(id, fingerprint)``, the fingerprint as a signed long."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py() or "", width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["id", "fingerprint"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(signed, f"id {kind}, fingerprint long")


def fingerprint_of(text: Column, width: int) -> Column:
    @F.pandas_udf("long")
    def signed(texts):
        return texts.map(lambda t: fingerprint(t, width)).astype("int64")

    return signed(text)


def gray_rank(code: Column) -> Column:
    """Place of a code in the sequence in which neighbours differ in one bit."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def table_masks(distance: int, bands: int) -> list[int]:
    """Signed masks of the bits that must agree, one per choice of ``bands - distance`` bands."""
    cuts = [round(i * BITS / bands) for i in range(bands + 1)]
    band = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(bands)]
    masks = [sum(chosen) for chosen in combinations(band, bands - distance)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


class GrayIndex:
    """Hierarchical index over codes sorted by (group, Gray rank)."""

    def __init__(self, codes: np.ndarray, group: np.ndarray, distance: int) -> None:
        self.codes, self.distance = codes, distance
        self.label = np.arange(len(codes))
        start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        size = np.diff(np.append(start, len(codes)))
        # Levels from the leaves up: first member, first child, bits agreed in and their pattern.
        self.levels: list[dict[str, np.ndarray]] = []
        ones = zeros = codes
        while True:
            n_nodes = -(-size // FAN_OUT)
            node_group = np.repeat(np.arange(len(size)), n_nodes)
            within = np.arange(len(node_group)) - np.repeat(np.cumsum(n_nodes) - n_nodes, n_nodes)
            first = start[node_group] + within * FAN_OUT
            ones, zeros = np.bitwise_and.reduceat(ones, first), np.bitwise_or.reduceat(zeros, first)
            last = np.append(first[1:], size.sum())
            self.levels.append({"first": first, "end": last, "mask": ~(ones ^ zeros), "pattern": ones})
            start, size = np.cumsum(n_nodes) - n_nodes, n_nodes
            if (n_nodes == 1).all():
                break
        below_end = None
        for level in self.levels:  # members under a node end where those under its last child end
            level["member_end"] = level["end"] if below_end is None else below_end[level["end"] - 1]
            level["member_first"] = level["first"] if below_end is None else below_first[level["first"]]
            below_end, below_first = level["member_end"], level["member_first"]
        for upper, lower in zip(self.levels[1:], self.levels):
            parent = np.repeat(np.arange(len(upper["first"])), upper["end"] - upper["first"])
            lower["own"] = lower["mask"] & ~upper["mask"][parent]
        self.levels[-1]["own"] = self.levels[-1]["mask"]
        self.root = np.searchsorted(self.levels[-1]["member_end"], np.arange(len(codes)), side="right")
        neighbours = np.flatnonzero((group[1:] == group[:-1]) & (np.bitwise_count(codes[1:] ^ codes[:-1]) <= distance))
        self.unite(neighbours, neighbours + 1)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the labels of linked codes; a label is the lowest place of its component."""
        label = self.label
        while len(a):
            la, lb = label[a], label[b]
            apart = la != lb
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                jumped = label[label]
                if (jumped == label).all():
                    break
                label = jumped
        self.label = label
        for level in self.levels:
            low = np.minimum.reduceat(label, level["member_first"]) if len(label) else label
            high = np.maximum.reduceat(label, level["member_first"]) if len(label) else label
            level["label"] = np.where(low == high, low, -1)

    def search(self, lo: int, hi: int) -> None:
        """Link the codes ``lo`` to ``hi`` with all codes behind them."""
        query = np.arange(lo, hi)
        node, missed = self.root[lo:hi], np.zeros(hi - lo, dtype=np.uint8)
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            missed = missed + np.bitwise_count((self.codes[query] ^ level["pattern"][node]) & level["own"][node])
            open_ = (missed <= self.distance) & (level["member_end"][node] > query + 1) & (level["label"][node] != self.label[query])
            query, node, missed = query[open_], node[open_], missed[open_]
            fan = level["end"][node] - level["first"][node]
            if fan.sum() > FRONTIER and hi - lo > 1:
                middle = (lo + hi) // 2
                self.search(lo, middle)
                self.search(middle, hi)
                return
            child = np.repeat(level["first"][node] - (np.cumsum(fan) - fan), fan) + np.arange(fan.sum())
            query, node, missed = np.repeat(query, fan), child, np.repeat(missed, fan)
        near = (node > query) & (self.label[node] != self.label[query])
        query, node = query[near], node[near]
        near = np.bitwise_count(self.codes[query] ^ self.codes[node]) <= self.distance
        if near.any():
            self.unite(query[near], node[near])

    def forest(self, step: int = 8_192) -> tuple[np.ndarray, np.ndarray]:
        """Linked codes and the code each component is named by."""
        for lo in range(0, len(self.codes), step):
            self.search(lo, min(lo + step, len(self.codes)))
        linked = np.flatnonzero(self.label != np.arange(len(self.codes)))
        return self.codes[linked], self.codes[self.label[linked]]


def _forests(distance: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by group and Gray rank; a window ends where a group ends."""
        held: list[np.ndarray] = []

        def links(rows: np.ndarray) -> pa.RecordBatch:
            group = np.cumsum(np.append(0, (rows[:-1, :3] != rows[1:, :3]).any(axis=1)))
            a, b = GrayIndex(rows[:, 3].view(np.uint64).copy(), group, distance).forest()
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1))
            if sum(map(len, held)) >= WINDOW_ROWS:
                rows = np.concatenate(held)
                ends = np.flatnonzero((rows[:-1, :3] != rows[1:, :3]).any(axis=1)) + 1
                cut = int(ends[-1]) if len(ends) else 0
                held = [rows[cut:]]
                if cut:
                    yield links(rows[:cut])
        if held and sum(map(len, held)):
            yield links(np.concatenate(held))

    return found


def near_links(codes: DataFrame, distance: int) -> DataFrame:
    """``(a, b)``: a spanning forest of the links within ``distance`` bits between distinct ``fingerprint`` values.

    ``codes`` is a written table. Groups of more than 20,000 fingerprints are cut into pieces by hash, and every pair
    of pieces is searched in a task of its own, so that no task holds more than two pieces; no pair is left out.
    """
    bands = distance + 1
    n_codes = codes.count()
    while n_codes > GROUP_ROWS << (BITS * (bands - distance) // bands) and bands < distance + 3:
        bands += 1
    masks = F.array(*[F.lit(m).cast("long") for m in table_masks(distance, bands)])
    parts = codes.select(F.posexplode(masks).alias("table", "_mask"), "fingerprint")
    parts = parts.select(F.col("table").cast("long"), F.col("fingerprint").bitwiseAND(F.col("_mask")).alias("shared"), "fingerprint")
    sizes = parts.groupBy("table", "shared").agg(F.count("*").alias("_n")).where(F.col("_n") > BLOCK_ROWS)
    large = materialise(sizes.select("table", "shared", F.ceil(F.col("_n") / BLOCK_ROWS).alias("_pieces")), "large-groups")
    cut = parts.join(large, ["table", "shared"], "left")
    own = F.pmod(F.xxhash64("fingerprint"), F.col("_pieces"))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("_pieces") - 1),
        lambda other: F.least(own, other) * F.col("_pieces") + F.greatest(own, other),
    )
    piece = F.explode(F.coalesce(F.when(F.col("_pieces").isNotNull(), pairs), F.array(F.lit(0).cast("long"))))
    dealt = cut.select("table", "shared", piece.alias("piece"), "fingerprint")
    tasks = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = (
        dealt.repartition(tasks, "table", "shared", "piece")
        .withColumn("_rank", gray_rank(F.col("fingerprint")))
        .sortWithinPartitions("table", "shared", "piece", "_rank")
        .select("table", "shared", "piece", "fingerprint")
    )
    return sorted_.mapInArrow(_forests(distance), "a long, b long")


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """``(id, fingerprint, component, component_id)`` for every row.

    Words are runs without white space in lower-cased text (A to Z only), shingles have ``width`` words, repeats
    included; a shorter text is one shingle. A NULL text counts as empty; texts without words have fingerprint zero
    and are linked like any other. Rows are in one component if a chain of fingerprints leads from one to the other in
    steps of at most ``distance`` bits; ``component_id`` is the smallest id in it. Two components may share it where ids
    repeat or are NULL; ``component``, the smallest fingerprint, tells them apart. Repeated rows and ids are kept, NULL
    ids get a component like others and do not name one unless all its ids are NULL. Other columns are not read. An
    empty table gives an empty result.
    """
    signed = materialise(add_fingerprints(df, id_col, text_col, width), "fingerprints")
    classes = materialise(signed.groupBy("fingerprint").agg(F.min("id").alias("lowest")), "fingerprint-classes")
    links = materialise(near_links(classes.select("fingerprint"), distance), "fingerprint-links")
    members = materialise(connected_components(links).withColumnRenamed("id", "fingerprint"), "fingerprint-components")
    linked = classes.join(members, "fingerprint")
    named = linked.groupBy("component").agg(F.min("lowest").alias("component_id"))
    moved = linked.join(named, "component").select("fingerprint", "component", "component_id")
    alone = [F.coalesce("component", "fingerprint").alias("component"), F.coalesce("component_id", "lowest").alias("component_id")]
    labels = classes.join(moved, "fingerprint", "left").select("fingerprint", *alone)
    # Written, so that the join has a plain exchange on both sides, which Spark can split at a hot fingerprint.
    labels = materialise(labels, "fingerprint-labels")
    return signed.join(labels, "fingerprint").select("id", "fingerprint", "component", "component_id")


def hex_code(code: Column) -> Column:
    return F.lpad(F.lower(F.hex(code)), 16, "0")


def keep_one(df: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """One row of each component: of the rows with its smallest id that with the smallest fingerprint, and of these the
    one with the smallest text. ``groups`` is the written result of ``simhash_groups`` for the same columns and width.

    A row is known by its id where the id occurs once; rows of repeated ids, NULL among them, get their fingerprint
    again and are known by both. All columns are kept, whatever their names.
    """
    names = F.col("id").eqNullSafe(F.col("component_id"))
    ids = groups.groupBy("id").agg(F.count("*").alias("_n"), F.max(names).alias("_names")).where("_names")
    ids = materialise(ids.select(F.col("id").alias("_kept"), "_n"), "kept")
    # The ids grow with the corpus, so they are never broadcast: the same plan at every size.
    once = ids.where(F.col("_n") == 1).select("_kept").hint("merge")
    # The row goes along as one value, so that no column of it clashes with those made here.
    rows = df.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    single = rows.join(once, F.col("_id").eqNullSafe(F.col("_kept")), "left_semi").select("_row.*")
    again = ids.where(F.col("_n") > 1).select("_kept").hint("merge")
    named = groups.where(names).groupBy("component", "id").agg(F.min("fingerprint").alias("_code"))
    named = named.join(again, F.col("id").eqNullSafe(F.col("_kept")), "left_semi").select(F.col("id").alias("_kept"), "_code")
    repeated = rows.join(again, F.col("_id").eqNullSafe(F.col("_kept")), "left_semi").withColumn("_own", fingerprint_of(F.col("_text"), width))
    same = F.col("_id").eqNullSafe(F.col("_kept")) & (F.col("_own") == F.col("_code"))
    chosen = repeated.join(named.hint("merge"), same, "left_semi").groupBy("_id", "_own")
    first = chosen.agg(F.min(F.struct(F.col("_row").getField(text_col).alias("_text"), "_row")).alias("_first"))
    return single.unionByName(first.select("_first._row.*"))
