"""XXH64 with seed 0 of packed k-mers and minimizers, and hash windows.

Spark's own xxhash64 has another seed, so these are Arrow functions over numpy
vectors. They are called on distinct k-mers, behind the aggregation; they are
declared non-deterministic so that the optimizer moves no inferred filter that
calls them ahead of it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: The primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotate(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def _lane(acc, word: np.ndarray) -> np.ndarray:
    return _rotate(acc + word * P2, 31) * P1


def xxh64_words(words: list[np.ndarray], seed: int = 0) -> np.ndarray:
    """XXH64 of rows of little-endian 64-bit words, words[0] first."""
    seed, n = np.uint64(seed), len(words)
    zero = np.zeros(len(words[0]), np.uint64)
    with np.errstate(over="ignore"):
        if n >= 4:
            acc = [zero + (seed + P1 + P2), zero + (seed + P2), zero + seed, zero + (seed - P1)]
            full = n - n % 4
            for k in range(0, full, 4):
                acc = [_lane(a, w) for a, w in zip(acc, words[k : k + 4], strict=True)]
            h = sum(_rotate(a, r) for a, r in zip(acc, (1, 7, 12, 18), strict=True))
            for a in acc:
                h = (h ^ _lane(np.uint64(0), a)) * P1 + P4
        else:
            full, h = 0, zero + (seed + P5)
        h = h + np.uint64(8 * n)
        for w in words[full:]:
            h = _rotate(h ^ _lane(np.uint64(0), w), 27) * P1 + P4
        return _finish(h)


def xxh64_u32(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of little-endian 32-bit numbers."""
    with np.errstate(over="ignore"):
        h = np.uint64(seed) + P5 + np.uint64(4) ^ x.astype(np.uint64) * P1
        return _finish(_rotate(h, 23) * P2 + P3)


def pack(kmers: pd.Series) -> list[np.ndarray]:
    """64-bit words of equally long digit strings, 2 bits a base, least significant word first."""
    k = len(kmers.iloc[0])
    d = np.frombuffer("".join(kmers).encode(), np.uint8).reshape(-1, k).astype(np.uint64) - np.uint64(48)
    words = []
    for end in range(k, 0, -32):
        w = np.zeros(len(d), np.uint64)
        for j in range(max(0, end - 32), end):
            w = (w << np.uint64(2)) | d[:, j]
        words.append(w)
    return words


def kmer_hash(d: Column, window: int) -> Column:
    """XXH64 (seed 0) of the packed words of a k-mer's digits, unsigned, modulo a window size."""

    @pandas_udf("bigint")
    def hashed(kmers: pd.Series) -> pd.Series:
        if not len(kmers):
            return pd.Series([], dtype="int64")
        return pd.Series((xxh64_words(pack(kmers)) % np.uint64(window)).astype(np.int64))

    return hashed.asNondeterministic()(d.cast("string"))


def minimizer_partition(number: Column, n_partitions: int) -> Column:
    """The static partition of a minimizer: XXH64 of its 32-bit number, modulo the number of partitions."""

    @pandas_udf("int")
    def part(x: pd.Series) -> pd.Series:
        return pd.Series((xxh64_u32(x.to_numpy(np.uint32)) % np.uint64(n_partitions)).astype(np.int32))

    return part.asNondeterministic()(number)


@dataclass(frozen=True)
class HashWindow:
    """Slots of a Bloom filter dealt to partitions in windows of whole 64-bit words."""

    bloom_size: int
    partitions: int

    @property
    def window(self) -> int:
        return -(-(-(-self.bloom_size // self.partitions)) // 64) * 64

    @property
    def slots(self) -> int:
        return self.window * self.partitions

    def lower(self, partition: int) -> int:
        return partition * self.window

    def upper(self, partition: int) -> int:
        return (partition + 1) * self.window - 1

    def slot(self, d: Column, partition: Column) -> Column:
        return kmer_hash(d, self.window) + partition.cast("bigint") * F.lit(self.window)

    def partition_of(self, slot: Column) -> Column:
        return F.floor(slot / F.lit(self.window)).cast("int")
