"""Near duplicates by MinHash bands, verified by odd sketches and then on full shingle sets.

A text's MinHash samples are folded into a bitmap: each sample flips one bit, so a bit holds the parity of the samples
that fell on it. Samples that two texts share cancel out in the XOR of their bitmaps; its population count z estimates
the number of samples that differ as -(n / 2) ln(1 - 2 z / n), and with it the similarity, best where it is high.

Texts are grouped by their sets first, so copies are signed but searched for once. Distinct sets that share a band are
compared by their sketches inside the bucket; what the sketches connect, with a margin of several standard deviations
below the asked similarity, makes one family, and a family's full sets meet once and are compared exactly. Buckets and
families give spanning forests, never their pairs. Those too large for one task are cut into pieces that all get a copy
of the group's first member; what that does not connect with it meets all pieces in a second step, so no link is left
out and a group of like texts moves only once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import exp

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import materialise
from postmill.operators.components import connected_components
from postmill.operators.forests import link_members, named_links, spanning_links, whole_groups

WIDTH = 5
BANDS, ROWS = 42, 6  # a pair at 0.85 is missed by all bands once in 400 million
SAMPLES = BANDS * ROWS
BITS = 512
MARGIN = 0.15  # taken off the similarity where sketches decide: over six standard deviations at 0.85
SEED = 42
CHUNK = 1 << 20  # bytes of text cut into words at once
BLOCK = 4_096  # shingle hashes put through all samples at once
BUCKET_ROWS = 4_096  # sketches of a bucket searched in one piece
FAMILY_ROWS = 512  # sets of a family searched in one piece
FAMILY_BYTES = 1 << 25  # of these sets
COMPARED = 1 << 22  # shingle hashes looked up at once

_draw = np.random.RandomState(SEED)
_FACTOR = _draw.randint(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSET = _draw.randint(0, 1 << 63, SAMPLES, dtype=np.uint64)
_PLACE = _draw.randint(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words(text: str, size: int = CHUNK) -> Iterator[list[bytes]]:
    """Runs without white space of the text, A to Z in lower case, a piece of the text at a time."""
    rest = b""
    for lo in range(0, len(text), size):
        part = rest + text[lo : lo + size].encode().lower()
        found = part.split()
        # The last word may go on in the next piece.
        rest = found.pop() if found and not part[-1:].isspace() else b""
        yield found
    if rest:
        yield [rest]


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; of the whole sequence where it is shorter than one, none without words."""
    hash64, found, open_ = xxhash.xxh64_intdigest, [], []
    for more in words(text):
        open_ += more
        last = len(open_) - width + 1
        if last > 0:
            found.append(np.fromiter((hash64(b" ".join(open_[i : i + width]), SEED) for i in range(last)), np.uint64, last))
            open_ = open_[last:]
    if not found and open_:
        found.append(np.array([hash64(b" ".join(open_), SEED)], dtype=np.uint64))
    return np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.uint64)


def samples(hashes: np.ndarray) -> np.ndarray:
    """The MinHash sample of every permutation over a set that is not empty."""
    lowest = np.full(SAMPLES, np.iinfo(np.uint64).max)
    for lo in range(0, len(hashes), BLOCK):
        mixed = hashes[lo : lo + BLOCK, None] * _FACTOR
        mixed += _OFFSET
        np.minimum(lowest, mixed.min(axis=0), out=lowest)
    return lowest


def odd_sketch(lowest: np.ndarray) -> bytes:
    """Every sample flips the bit it is hashed to."""
    place = (((lowest >> np.uint64(17)) ^ lowest) * _PLACE) >> np.uint64(64 - BITS.bit_length() + 1)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes()


def estimate(differing: np.ndarray, bits: int = BITS, count: int = SAMPLES) -> np.ndarray:
    """Similarity from the population count of the XOR of two sketches."""
    return 1 + bits / (4 * count) * np.log(np.maximum(1 - 2 * np.asarray(differing) / bits, 1e-9))


def most_differing(similarity: float) -> int:
    """Population count up to which two sketches may belong to texts of that similarity, the margin included."""
    apart = 2 * SAMPLES * (1 - max(similarity - MARGIN, 0))
    return int(BITS / 2 * (1 - exp(-2 * apart / BITS)))


def sign(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text_key, n_shingles, name, bands, sketch)``; ``name`` is a 128-bit digest of the set, NULL like what follows for
    an empty one, and ``text_key`` a hash of the text."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, name, bands, sketch = [], [], [], []
            for text in batch.column(2):
                found = shingle_set(text.as_py() or "")
                count.append(len(found))
                name.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                lowest = samples(found) if len(found) else None
                bands.append(None if lowest is None else [xxhash.xxh64_intdigest(lowest[i : i + ROWS].tobytes(), i) - (1 << 63) for i in range(0, SAMPLES, ROWS)])
                sketch.append(None if lowest is None else odd_sketch(lowest))
            columns = [batch.column(0), batch.column(1), pa.array(count, pa.int64()), pa.array(name, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text_key", "n_shingles", "name", "bands", "sketch"])

    kind = df.schema[id_col].dataType.simpleString()
    columns = [F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")]
    return df.select(*columns).mapInArrow(signed, f"id {kind}, text_key long, n_shingles long, name binary, bands array<long>, sketch binary")


def _bitmaps(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), BITS // 64)


def _possible(sketches: np.ndarray, sizes: np.ndarray, most: int, ratio: tuple[int, int]) -> Callable[[int | np.ndarray, np.ndarray], np.ndarray]:
    """Whether sizes allow the similarity and sketches differ in at most ``most`` bits."""
    part, whole = ratio

    def possible(one: int | np.ndarray, others: np.ndarray) -> np.ndarray:
        sized = whole * np.minimum(sizes[others], sizes[one]) >= part * np.maximum(sizes[others], sizes[one])
        return sized & (np.bitwise_count(sketches[others] ^ sketches[one]).sum(axis=1, dtype=np.int64) <= most)

    return possible


def _bucket_links(most: int, ratio: tuple[int, int]):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, start in whole_groups(batches):
            possible = _possible(_bitmaps(table.column("sketch")), table.column("n_shingles").to_numpy(), most, ratio)
            # Most buckets hold sets like their first one: all are compared with it at once.
            near = possible(np.repeat(start[:-1], np.diff(start)), np.arange(table.num_rows)) & table.column("label").is_null().to_numpy()
            for lo, hi in zip(start[:-1].tolist(), start[1:].tolist()):
                if near[lo:hi].all():
                    yield named_links(table, np.full(hi - lo - 1, lo), np.arange(lo + 1, hi))
                    continue
                a, b = link_members(table.slice(lo, hi - lo), lambda one, others, lo=lo: others[possible(lo + one, lo + others)])
                if len(a):
                    yield named_links(table, lo + a, lo + b)

    return found


def _family_links(most: int, ratio: tuple[int, int]):
    part, whole = ratio

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, start in whole_groups(batches):
            for lo, hi in zip(start[:-1].tolist(), start[1:].tolist()):
                rows = table.slice(lo, hi - lo)
                sets = [np.frombuffer(x, dtype=np.uint64) for x in rows.column("hashes").to_pylist()]
                sizes = np.array([len(x) for x in sets])
                possible = _possible(_bitmaps(rows.column("sketch")), sizes, most, ratio)

                def alike(one: int, others: np.ndarray) -> np.ndarray:
                    """Exact similarity of full sets."""
                    others, mine, out = others[possible(one, others)], sets[one], []
                    step = max(1, COMPARED // max(int(sizes[others].max(initial=1)), 1))
                    for at in range(0, len(others), step):
                        few = others[at : at + step]
                        flat = np.concatenate([sets[i] for i in few])
                        place = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
                        both = np.add.reduceat(mine[place] == flat, np.append(0, np.cumsum(sizes[few])[:-1]), dtype=np.int64)
                        out.append(few[whole * both >= part * (len(mine) + sizes[few] - both)])
                    return np.concatenate(out) if out else others

                a, b = link_members(rows, alike)
                if len(a):
                    yield named_links(rows, a, b)

    return found


def _families(signed: DataFrame, most: int, ratio: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """``(name, lowest, text_key, n_shingles, sketch)`` of the distinct sets, and ``(name, family)`` of those that sketches connect."""
    text_key = F.coalesce(F.min_by("text_key", "id"), F.min("text_key")).alias("text_key")
    sets = signed.where("name IS NOT NULL").groupBy("name").agg(
        F.min("id").alias("lowest"), text_key, *[F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch")]
    )
    sets = materialise(sets, "distinct-sets")
    # Only keys that several sets share meet the sketches.
    keys = sets.select("name", F.explode("bands").alias("key"))
    shared = materialise(keys.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key"), "shared-bands")
    hits = materialise(keys.join(shared, "key", "left_semi"), "band-hits").join(sets.select("name", "n_shingles", "sketch"), "name")
    families = connected_components(spanning_links(hits, "key", F.count("*") / BUCKET_ROWS, ["n_shingles", "sketch"], _bucket_links(most, ratio)))
    return sets.drop("bands"), materialise(families.select(F.col("id").alias("name"), F.col("component").alias("family")), "families")


def _full_sets(df: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """``(name, hashes)`` of ``wanted (name, lowest, text_key): the full set of each, taken again from a text of that set."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py() or "") for text in batch.column(0)]
            hashes, own = [x.tobytes() for x in sets], [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            kept = pa.array([a == b.as_py() for a, b in zip(own, batch.column(1))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(hashes, pa.binary())], names=["name", "hashes"]).filter(kept)

    texts = df.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_key"), F.col(text_col).alias("_text"))
    same = F.col("_id").eqNullSafe(F.col("lowest")) & (F.col("_key") == F.col("text_key"))
    met = texts.join(wanted.select("name", "lowest", "text_key").hint("merge"), same)
    # Rows may be repeated; should a text of another set have the same id and key, its digest tells.
    return met.select("_text", "name").mapInArrow(hashed, "name binary, hashes binary").dropDuplicates(["name"])


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: tuple[int, int] = (85, 100)) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for every row.

    Words are runs without white space, A to Z in lower case. A text's set holds its distinct shingles of five words; a
    shorter text is one shingle, and a NULL text or one without words has the empty set, is linked with nothing and is
    its own component. Two texts are linked if the Jaccard similarity of their full sets, as 64-bit hashes of the
    shingles, is at least ``similarity[0] / similarity[1]``. ``component_id`` is the smallest id that a chain of links
    leads to, the own one included; ``kept`` says whether it is the own id. Repeated rows and ids are kept. NULL ids
    belong to components like others and name one only if it has no other id. Other columns are not read. An empty
    table gives an empty result.

    Bands and sketches pass over a pair at 0.85 about once in 400 million; at another ``similarity`` the chance is
    (1 - s ** 6) ** 42. Runs jobs. ``df`` is read twice: by all rows, and by texts that may have a partner.
    """
    ratio = similarity
    most = most_differing(ratio[0] / ratio[1])
    signed = materialise(sign(df, id_col, text_col), "signed")
    sets, families = _families(signed, most, ratio)
    members = materialise(families.join(sets, "name"), "family-members")
    full = members.select("name", "family", "sketch").join(_full_sets(df, id_col, text_col, members), "name")
    full = materialise(full, "family-sets")
    fill = F.greatest(F.count("*") / FAMILY_ROWS, F.sum(F.octet_length("hashes")) / FAMILY_BYTES)
    links = spanning_links(full, "family", fill, ["sketch", "hashes"], _family_links(most, ratio))
    components = connected_components(links).withColumnRenamed("id", "name")
    linked = materialise(sets.select("name", "lowest").join(components, "name"), "linked-sets")
    named = linked.groupBy("component").agg(F.min("lowest").alias("component_id"))
    moved = linked.join(named, "component").select("name", "component_id")
    labels = sets.join(moved, "name", "left").select("name", F.coalesce("component_id", "lowest").alias("component_id"))
    # Written, so that the join has a plain exchange on both sides, which Spark can split at a set that many rows share.
    labels = materialise(labels, "set-labels")
    empty = signed.where("name IS NULL").select("id", "n_shingles", F.col("id").alias("component_id"))
    rows = signed.where("name IS NOT NULL").join(labels, "name").select("id", "n_shingles", "component_id").unionByName(empty)
    return rows.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
