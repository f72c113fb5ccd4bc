"""Exact similarity links between token sets by prefix filter.

All tokens have one global order, the rarer the earlier. Two sets of Jaccard similarity t or more share a token in the
first n - ceil(t n) + 1 of either, so sets are indexed by these prefixes only, under the token and a class of lengths:
sets whose lengths allow the similarity fall into one class or two neighbouring ones.

Any order is correct, so frequencies are counted per hash value of the token, of which there is a fixed number, and the
vocabulary itself is never joined. In a bucket sets are compared by parity bitmaps: each token flips one bit, so the
number of bits in which two bitmaps differ is never more than the number of tokens in which the sets differ, and a pair
that differs in too many bits cannot be similar. What the bitmaps connect makes a family; the full sets of a family
meet once and are compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, starmap
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.operators.components import connected_components
from postmill.operators.forests import link_members, named_links, spanning_links, whole_groups
from postmill.sources.scratch import materialise, small_batches

COUNTERS = 1 << 18  # hash values whose frequencies are counted: 2 MB, whatever the vocabulary
BITS = 512  # of a bitmap in a bucket
FINE_BITS = 4_096  # of one in a family, made where it is needed
BUCKET_ROWS = 4_096
FAMILY_ROWS = 512
FAMILY_BYTES = 1 << 25
COMPARED = 1 << 20  # tokens looked up at once

_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def token_sets(texts: DataFrame, tokens: Column) -> DataFrame:
    """``(name, hashes)``: 64-bit hashes of the distinct ``tokens`` of every row."""
    return texts.select("name", F.transform(F.array_distinct(tokens), lambda t: F.xxhash64(t)).alias("hashes"))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return flat, np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))


def _numbers(column: pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of every chunk its binary values as 64-bit numbers, one after another where they lie, and the places where they
    begin, and the end."""
    for chunk in column.chunks:
        if len(chunk):
            chunk = chunk.cast(pa.large_binary())
            _, ends, data = chunk.buffers()
            ends = np.frombuffer(ends, dtype=np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
            yield np.frombuffer(data, dtype=np.uint64, count=(ends[-1] - ends[0]) // 8, offset=ends[0]), (ends - ends[0]) // 8


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(COUNTERS)).astype(np.int64)


def token_frequencies(sets: DataFrame) -> np.ndarray:
    """In how many sets the tokens of each hash value occur. The driver gets one number per hash value."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_counter(_lists(batch.column(0))[0]), minlength=COUNTERS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["counter", "n"])

    with small_batches(sets.sparkSession):
        found = sets.select("hashes").mapInArrow(count, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, dtype=np.int64)
    out[found.column("counter").to_numpy()] = found.column("n").to_numpy()
    return out


def bitmap(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmap of a set."""
    place = (hashes * _SPREAD) >> np.uint64(64 - bits.bit_length() + 1)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.uint64)


def prefix_length(size: int, threshold: float) -> int:
    return size - ceil(threshold * size - 1e-6) + 1


def length_class(size: int, threshold: float) -> int:
    """Sizes that allow the similarity differ by one class at most."""
    return size if threshold >= 1 else int(log(size) / log(1 / threshold) * (1 - 1e-9))


def index_sets(sets: DataFrame, threshold: float, prefixes: bool = True) -> DataFrame:
    """``(name, size, keys, bitmap, hashes)`` with sorted hashes as bytes; without ``prefixes`` there are no keys.

    A key names a token of the prefix and a class of lengths, its own or the next.
    """
    frequencies = sets.sparkSession.sparkContext.broadcast(token_frequencies(sets)) if prefixes else None

    def keys_of(hashes: np.ndarray) -> np.ndarray:
        first = hashes[np.lexsort((hashes, frequencies.value[_counter(hashes)]))][: prefix_length(len(hashes), threshold)]
        own = length_class(len(hashes), threshold)
        return np.concatenate([(first + np.uint64(c)) * _SPREAD for c in (own, own + 1)])

    def index(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, ends = _lists(batch.column(1))
        flat = flat.copy()  # sorted in place, and sent as it is
        own = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
        for hashes in own:
            hashes.sort()
        keys = [np.unique(keys_of(h)).view(np.int64) if prefixes else np.empty(0, dtype=np.int64) for h in own]
        places = pa.array(ends * flat.itemsize, pa.int32()).buffers()[1]
        columns = [
            batch.column(0),
            pa.array(np.diff(ends), pa.int64()),
            pa.array(keys, pa.list_(pa.int64())),
            pa.array([bitmap(h, BITS).tobytes() for h in own], pa.binary()),
            pa.Array.from_buffers(pa.binary(), len(own), [None, places, pa.py_buffer(flat)]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["name", "size", "keys", "bitmap", "hashes"])

    kind = sets.schema["name"].dataType.simpleString()
    # No batch is held while the next one is read.
    return sets.select("name", "hashes").mapInArrow(lambda batches: map(index, batches), f"name {kind}, size long, keys array<long>, bitmap binary, hashes binary")


def _possible(maps: np.ndarray, sizes: np.ndarray, threshold: float) -> Callable[[int | np.ndarray, np.ndarray], np.ndarray]:
    """Whether lengths and bitmaps of two sets allow the similarity: sets of n and m tokens may differ in
    (n + m) (1 - t) / (1 + t) of them."""
    share = (1 - threshold) / (1 + threshold)

    def possible(one: int | np.ndarray, others: np.ndarray) -> np.ndarray:
        apart = np.bitwise_count(maps[others] ^ maps[one]).sum(axis=1, dtype=np.int64)
        both = sizes[others] + sizes[one]
        return (np.minimum(sizes[others], sizes[one]) >= threshold * np.maximum(sizes[others], sizes[one]) - 1e-6) & (apart <= share * both + 1e-6)

    return possible


def _by_groups(links: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]]):
    """``links`` of the tables of ``whole_groups``, none of which is held while the next one is gathered."""
    return lambda batches: chain.from_iterable(starmap(links, whole_groups(batches)))


def _bucket_links(threshold: float):
    def links(table: pa.Table, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        maps = np.concatenate([flat for flat, _ in _numbers(table.column("bitmap"))]).reshape(table.num_rows, -1)
        possible = _possible(maps, table.column("size").to_numpy(), threshold)
        # Most buckets hold sets like their first one: all are compared with it at once.
        like_first = possible(np.repeat(start[:-1], np.diff(start)), np.arange(table.num_rows)) & table.column("label").is_null().to_numpy()
        for lo, hi in zip(start[:-1].tolist(), start[1:].tolist()):
            if like_first[lo:hi].all():
                yield named_links(table, np.full(hi - lo - 1, lo), np.arange(lo + 1, hi))
                continue
            near = lambda one, others, lo=lo: others[possible(lo + one, lo + others)]
            a, b = link_members(table.slice(lo, hi - lo), near)
            if len(a):
                yield named_links(table, lo + a, lo + b)

    return _by_groups(links)


def _family_links(threshold: float):
    def links(table: pa.Table, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo, hi in zip(start[:-1].tolist(), start[1:].tolist()):
            rows = table.slice(lo, hi - lo)
            sets = [flat[a:b] for flat, ends in _numbers(rows.column("hashes")) for a, b in zip(ends[:-1], ends[1:])]
            sizes, found = np.array([len(x) for x in sets]), {}
            possible = _possible(np.stack([bitmap(x, FINE_BITS) for x in sets]), sizes, threshold)

            def near(one: int, others: np.ndarray) -> np.ndarray:
                others, mine, kept = others[possible(one, others)], sets[one], []
                step = max(1, COMPARED // max(int(sizes[others].max(initial=1)), 1))
                for at in range(0, len(others), step):
                    few = others[at : at + step]
                    flat = np.concatenate([sets[i] for i in few])
                    place = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
                    both = np.add.reduceat(mine[place] == flat, np.append(0, np.cumsum(sizes[few])[:-1]), dtype=np.int64)
                    similarity = both / (len(mine) + sizes[few] - both)
                    alike = similarity >= threshold
                    found.update(((one, int(i)), s) for i, s in zip(few[alike], similarity[alike]))
                    kept.append(few[alike])
                return np.concatenate(kept) if kept else others

            a, b = link_members(rows, near)
            if len(a):
                yield named_links(rows, a, b, jaccard=np.array([found[pair] for pair in zip(a.tolist(), b.tolist())]))

    return _by_groups(links)


def similar_sets(sets: DataFrame, threshold: float, keys: DataFrame | None = None) -> DataFrame:
    """``(a, b, jaccard)``: links that span the components of all pairs of similarity ``threshold`` or more.

    ``sets`` is ``(name, hashes)``, at least one hash in each, names distinct. No pair is missed. With ``keys (name, key)``
    only sets that share one of these are looked at first, and all pairs of a family then. Runs jobs.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    with small_batches(sets.sparkSession):
        indexed = materialise(index_sets(sets, threshold, keys is None), "indexed-sets")
    every = indexed.select("name", F.explode("keys").alias("key")) if keys is None else keys
    shared = materialise(every.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key"), "shared-keys")
    hits = materialise(every.join(shared, "key", "left_semi"), "hits").join(indexed.select("name", "size", "bitmap"), "name")
    possible = spanning_links(hits, "key", F.count("*") / BUCKET_ROWS, ["size", "bitmap"], _bucket_links(threshold))
    families = connected_components(possible).select(F.col("id").alias("name"), F.col("component").alias("family"))
    full = materialise(families.join(indexed.select("name", "hashes"), "name"), "family-sets")
    fill = F.greatest(F.count("*") / FAMILY_ROWS, F.sum(F.octet_length("hashes")) / FAMILY_BYTES)
    return spanning_links(full, "family", fill, ["hashes"], _family_links(threshold), "jaccard double")
