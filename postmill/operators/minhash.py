"""MinHash signatures and their bands.

Signatures equal those of the widely used public MinHash scheme with SHA-1 token hashes and seed 1, so band
collisions, and with them duplicate groups, are reproducible anywhere.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import fixed

# Fixed values of the signature scheme.
MERSENNE_PRIME = (1 << 61) - 1
MAX_HASH = (1 << 32) - 1
SEED = 1

_BLOCK = 1_024  # hashes permuted per NumPy call: 1 MB of products for 128 permutations
_SPAN = 65_536  # tokens that share a table of distinct hashes: 32 MB at most


@lru_cache(maxsize=None)
def permutations(num_perm: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of the permutations, drawn in turn from the seeded generator."""
    draw = np.random.RandomState(SEED)
    pairs = [
        (draw.randint(1, MERSENNE_PRIME, dtype=np.uint64), draw.randint(0, MERSENNE_PRIME, dtype=np.uint64))
        for _ in range(num_perm)
    ]
    a, b = np.array(pairs, dtype=np.uint64).T
    return a.copy(), b.copy()


def token_digests(text_col: str) -> Column:
    """The first four bytes of the SHA-1 of every distinct token between single spaces, one after another."""
    tokens = F.array_distinct(F.split(text_col, " ", -1))
    return F.unhex(F.array_join(F.transform(tokens, lambda t: F.substring(F.sha1(t.cast("binary")), 1, 8)), ""))


def permuted(hashes: np.ndarray, num_perm: int) -> np.ndarray:
    """One row per hash, one column per permutation."""
    a, b = permutations(num_perm)
    out = np.empty((len(hashes), num_perm), dtype=np.uint32)
    for lo in range(0, len(hashes), _BLOCK):
        mixed = hashes[lo : lo + _BLOCK, None] * a  # wraps at 64 bits, as the scheme does
        mixed += b
        mixed %= np.uint64(MERSENNE_PRIME)
        out[lo : lo + _BLOCK] = mixed & np.uint64(MAX_HASH)
    return out


def minima(hashes: np.ndarray, starts: np.ndarray, num_perm: int) -> np.ndarray:
    """Row ``i``: minimum of every permutation over ``hashes[starts[i]:starts[i + 1]]``; no run may be empty.

    Tokens repeat a lot, so each span of tokens permutes its distinct hashes only.
    """
    out = np.full((len(starts) - 1, num_perm), MAX_HASH, dtype=np.uint32)
    for lo in range(0, len(hashes), _SPAN):
        hi = min(lo + _SPAN, len(hashes))
        distinct, where = np.unique(hashes[lo:hi], return_inverse=True)
        table = permuted(distinct, num_perm)
        first = np.searchsorted(starts, lo, side="right") - 1
        last = np.searchsorted(starts, hi, side="left")
        for i in range(first, last):
            run = where[max(starts[i], lo) - lo : min(starts[i + 1], hi) - lo]
            np.minimum(out[i], table[run].min(axis=0), out=out[i])
    return out


def signatures(digests: pd.Series, num_perm: int) -> np.ndarray:
    """One row per text's digests, none of which may be missing or empty; a digest is read from the low end."""
    starts = np.append(0, np.cumsum([len(d) // 4 for d in digests]))
    return minima(np.frombuffer(b"".join(digests), dtype="<u4").astype(np.uint64), starts, num_perm)


def minhash_signature(df: DataFrame, text_col: str = "text", num_perm: int = fixed.NUM_PERM) -> DataFrame:
    """Add ``signature``: one minimum per permutation over the tokens between single spaces; NULL for a NULL text.

    Tokens are hashed in the JVM; only 32 bits of each reach Python, in Arrow batches.
    """

    @F.pandas_udf("array<long>")
    def sign(digests: pd.Series) -> pd.Series:
        known = digests.notna()
        signed = iter(signatures(digests[known], num_perm).astype(np.int64))
        return pd.Series([next(signed) if ok else None for ok in known])

    return df.withColumn("signature", sign(token_digests(text_col)))


def band_keys(
    df: DataFrame, id_col: str, bands: int, rows: int, text_col: str = "text", num_perm: int = fixed.NUM_PERM
) -> DataFrame:
    """``(id, key)``, one 16-byte key per band of each text's signature; equal keys mean equal bands.

    Keys are cut from the signature where it is computed, so the signature itself does not travel.
    """

    @F.pandas_udf("array<binary>")
    def keys(digests: pd.Series) -> pd.Series:
        signed = np.ascontiguousarray(signatures(digests, num_perm))
        cuts = [(i.to_bytes(2, "little"), i * rows, (i + 1) * rows) for i in range(bands)]
        return pd.Series([[hashlib.md5(name + row[lo:hi].tobytes()).digest() for name, lo, hi in cuts] for row in signed])

    texts = df.select(F.col(id_col).alias("id"), text_col).where(F.col(text_col).isNotNull())
    return texts.select("id", F.explode(keys(token_digests(text_col))).alias("key"))


@lru_cache(maxsize=None)
def best_bands(threshold: float = fixed.THRESHOLD, num_perm: int = fixed.NUM_PERM, fp: float = 0.5, fn: float = 0.5) -> tuple[int, int]:
    """Bands and rows per band that minimise the weighted area of false positives and false negatives."""
    steps = 2_000
    below = (np.arange(steps) + 0.5) * threshold / steps
    above = threshold + (np.arange(steps) + 0.5) * (1 - threshold) / steps
    best = (float("inf"), 0, 0)
    for bands in range(1, num_perm + 1):
        for rows in range(1, num_perm // bands + 1):
            false_hits = np.mean(1 - (1 - below**rows) ** bands) * threshold
            misses = np.mean((1 - above**rows) ** bands) * (1 - threshold)
            best = min(best, (fp * false_hits + fn * misses, bands, rows))
    return best[1], best[2]
