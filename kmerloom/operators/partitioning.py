"""Minimizer partitions and super-k-mers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import dna, hashing
from ._batches import rolling

#: The most k-mers of a super-k-mer.
LONGEST = 255
#: K-mers of a read looked at together.
BLOCK = 1 << 20
#: The code of characters other than A, C, T, G.
OTHER = 4
#: As many m-mers are counted in one array.
MMERS = 1 << 20


def with_minimizer(kmers: DataFrame, k: int, m: int) -> DataFrame:
    """Adds minimizer, a number."""
    dna.check_m(m, k)
    if k > 31:
        return kmers.withColumn("minimizer", dna.code(dna.minimizer(F.col("kmer"), k, m)))
    own = kmers.columns
    strands = kmers.select(*own, dna.strand_codes(F.col("kmer")).alias("strands_"))
    return strands.select(*own, dna.minimizer_of_codes(F.col("strands_.forward"), F.col("strands_.backward"), k, m).alias("minimizer"))


def count_mmers(codes: DataFrame, k: int, m: int) -> DataFrame:
    """(mmer, n): how often each canonical m-mer occurs in k-mers, both as numbers (code; k up to 31).

    A task adds up its m-mers before it passes them on: all of them together
    where m is small, else those of a batch.
    """
    dna.check_m(m, k)
    size, whole = 4**m, (1 << 2 * m) - 1

    def run(batches):
        held = np.zeros(size, np.int64) if size <= MMERS else None
        for b in batches:
            ahead = b.column(0).to_numpy(zero_copy_only=False)
            back = np.zeros_like(ahead)
            for j in range(k):
                back = back << 2 | (ahead >> 2 * j & 3 ^ 2)
            found = np.concatenate([np.minimum(ahead >> 2 * (k - m - j) & whole, back >> 2 * j & whole) for j in range(k - m + 1)])
            if held is None:
                x, n = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(n)], ["mmer", "n"])
            else:
                held += np.bincount(found, minlength=size)
        if held is not None:
            x = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(held[x])], ["mmer", "n"])

    return codes.select("code").mapInArrow(run, "mmer bigint, n bigint").groupBy("mmer").agg(F.sum("n").alias("n"))


def with_partition(kmers: DataFrame, k: int, m: int, n_partitions: int) -> DataFrame:
    """Adds part, the static partition of the k-mer's minimizer."""
    return with_minimizer(kmers, k, m).withColumn("part", hashing.minimizer_partition(F.col("minimizer"), n_partitions)).drop("minimizer")


def static_repartition(spark: SparkSession, m: int, n_partitions: int) -> DataFrame:
    """(minimizer, part) of all 4^m minimizers."""
    return spark.range(4**m).select(F.col("id").alias("minimizer"), hashing.minimizer_partition(F.col("id"), n_partitions).alias("part"))


def partition_sizes(kmers: DataFrame) -> DataFrame:
    """Number of rows of each part."""
    return kmers.groupBy("part").agg(F.count("*").alias("n_kmers"))


def restrict(kmers: DataFrame, parts: list[int], n_partitions: int) -> DataFrame:
    """Rows of some partitions only; an unknown partition is an error."""
    wrong = sorted(p for p in parts if not 0 <= p < n_partitions)
    if wrong:
        raise ValueError(f"no such partitions: {wrong}")
    return kmers.where(F.col("part").isin([int(p) for p in parts]))


def restrict_fraction(fraction: float, n_partitions: int, seed: int = 0) -> list[int]:
    """Numbers of a random share of the partitions, one at least."""
    import random

    return sorted(random.Random(seed).sample(range(n_partitions), max(1, int(n_partitions * fraction))))


def rolling_minimizers(codes: np.ndarray, k: int, m: int) -> np.ndarray:
    """Minimizers, as 32-bit numbers, of every k-mer of a sequence of digits; of no meaning where one holds another character (4)."""
    d = codes & 3
    x = np.minimum(rolling(d, m, kind=np.uint32), rolling(d ^ 2, m, True, np.uint32))
    pairs = np.uint32(sum(1 << 2 * p for p in range(m - 2)))  # one bit for each two neighbouring bases behind the first
    other = x | x >> 1
    x[(other | other >> 2) & pairs != pairs] = (1 << 2 * m) - 1
    width, whole = 1, k - m + 1
    while 2 * width <= whole:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    n = len(codes) - k + 1
    return np.minimum(x[:n], x[whole - width : whole - width + n])


def window_minimizers(codes: np.ndarray, k: int, m: int) -> np.ndarray:
    """Minimizers, as numbers, of every k-mer of a sequence of digits; -1 for those that hold another character (4)."""
    wrong = np.concatenate([[0], np.cumsum(codes == OTHER)])
    return np.where(wrong[k:] == wrong[:-k], rolling_minimizers(codes, k, m).astype(np.int64), -1)


def minimizer_runs(codes: np.ndarray, k: int, m: int, longest: int = LONGEST, block: int = BLOCK):
    """(starts, numbers of k-mers, minimizers) of the super-k-mers of a sequence of digits, some at a time."""
    n = len(codes) - k + 1
    start, value = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the last run may go on in the next block
    for at in range(0, n, block):
        x = window_minimizers(codes[at : at + block + k - 1], k, m)
        edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        new = edge[1:] if len(value) and value[0] == x[0] else edge
        start, value = np.concatenate([start, new + at]), np.concatenate([value, x[new]])
        last = at + block >= n
        length = np.diff(start, append=n)[: None if last else -1]
        pieces = np.where(value[: len(length)] < 0, 0, -(-length // longest))
        which = np.repeat(np.arange(len(length)), pieces)
        within = (np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * longest
        yield start[which] + within, np.minimum(longest, length[which] - within), value[which]
        start, value = start[-1:], value[-1:]


def super_kmers(reads: DataFrame, k: int, m: int, longest: int = LONGEST) -> DataFrame:
    """All columns of reads but seq, and run, start, n_kmers, minimizer: neighbouring k-mers of a read with one minimizer, cut at `longest`.

    run numbers the pieces of A, C, G, T of a read, start is a place in one.
    Reads are worked on where they lie, those of a batch together, in blocks of
    k-mers: nothing is shuffled, and reads of equal names (of other samples or
    files, or mates) stay apart.
    """
    dna.check_m(m, dna.check_k(k))
    own = [f for f in reads.schema.fields if f.name != "seq"]
    names = [*(f.name for f in own), "run", "start", "n_kmers", "minimizer"]
    digit = np.full(256, OTHER, np.uint8)
    for c, d in zip("ACTGactg", (0, 1, 2, 3) * 2, strict=True):
        digit[ord(c)] = d

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            kept = b.select(range(len(own)))
            texts = [t or b"" for t in b.column(len(own)).cast(pa.binary()).to_pylist()]
            first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[:-1]  # one more character parts two reads
            codes = digit[np.frombuffer(b"-".join(texts), np.uint8)]
            wrong = np.flatnonzero(codes == OTHER)
            inside = np.setdiff1d(wrong, first[1:] - 1, assume_unique=True)
            gaps = inside[np.diff(inside, prepend=-2) > 1]
            for at, n, value in minimizer_runs(codes, k, m, longest):
                i = np.searchsorted(first, at, side="right") - 1
                number = np.searchsorted(gaps, at) - np.searchsorted(gaps, first[i])
                before = np.searchsorted(wrong, at)
                piece = np.where(before > 0, wrong[before - 1] + 1, 0) if len(wrong) else np.zeros(len(at), np.int64)
                yield pa.RecordBatch.from_arrays([*kept.take(pa.array(i)).columns, pa.array(number.astype(np.int32)), pa.array(at - piece), pa.array(n), pa.array(value)], names)

    schema = StructType([*own, *StructType.fromDDL("run int, start bigint, n_kmers bigint, minimizer bigint").fields])
    return reads.select(*(F.col(f"`{f.name}`") for f in own), "seq").mapInArrow(run, schema)
