"""Counting k-mers and hash slots by sample.

reads: (sample, seq). Counts are in the long form (sample, kmer, cnt), kmer
being digits in the order A < C < T < G. Exploding, canonical form and partial
counts run ahead of the only shuffle, so a k-mer that fills a third of all
reads leaves each task as one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import dna, hashing
from . import _batches, _bins

#: Counts saturate here unless a call says otherwise.
MAX_COUNT = 4_294_967_295
HISTOGRAM = (1, 255)
#: The longest k-mers that are counted as numbers.
MOST_CODE = 31
#: Slots of all samples that a task adds up in one array.
HELD = 1 << 22
#: Minimizers of which a task lists every one's partition.
TABLED = 1 << 20


def explode_kmers(reads: DataFrame, k: int, *keep: str) -> DataFrame:
    """(keep..., position, kmer): the canonical k-mer at each position of each run of A, C, G, T.

    position is that in the run (from 0). Reads with null or short sequences give none.
    """
    dna.check_k(k)
    runs = reads.select(*keep, F.explode(dna.segments(F.col("seq"))).alias("run")).where(F.length("run") >= k)
    forward = dna.digits(F.col("run"))
    strands = runs.select(*keep, forward.cast("binary").alias("forward"), dna.reverse_complement_digits(forward).cast("binary").alias("backward"))
    placed = strands.select(*keep, "forward", "backward", F.explode(dna.kmer_positions(F.col("forward"), k)).alias("position"))
    return placed.select(*keep, "position", dna.kmer_at(F.col("forward"), F.col("backward"), F.col("position"), k).cast("string").alias("kmer"))


def count_kmers(reads: DataFrame, k: int) -> DataFrame:
    """(sample, kmer, cnt), every k-mer. Up to MOST_CODE bases they are counted as numbers, in bins (`_bins`)."""
    dna.check_k(k)
    if k > MOST_CODE:
        return explode_kmers(reads, k, "sample").groupBy("sample", "kmer").agg(F.count("*").alias("cnt"))
    return _bins.count(reads, k).select("sample", dna.code_digits(F.col("code"), k).alias("kmer"), "cnt")


def saturate(counts: DataFrame, max_count: int = MAX_COUNT) -> DataFrame:
    return counts.withColumn("cnt", F.least("cnt", F.lit(max_count)))


def hard_min(counts: DataFrame, least: int | Column) -> DataFrame:
    """Counts of at least a number, which may be a column (a sample's own)."""
    return counts.where(F.col("cnt") >= least)


def sample_min(sheet: DataFrame, default: int) -> DataFrame:
    """(sample, least): a sample's own hard minimum where it has one."""
    return sheet.select("sample", F.coalesce(F.nullif(F.col("min_abund"), F.lit(0)), F.lit(default)).alias("least"))


def histogram(counts: DataFrame, bounds: tuple[int, int] = HISTOGRAM) -> DataFrame:
    """(sample, abundance, n_unique, n_total) for abundances within bounds, over counts before any threshold."""
    low, high = bounds
    return counts.where(F.col("cnt").between(low, high)).groupBy("sample", F.col("cnt").alias("abundance")).agg(F.count("*").alias("n_unique"), F.sum("cnt").alias("n_total"))


def histogram_totals(counts: DataFrame, bounds: tuple[int, int] = HISTOGRAM) -> DataFrame:
    """Distinct k-mers and occurrences of each sample: all, below and above the bounds."""
    low, high = bounds
    cnt = F.col("cnt")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return counts.groupBy("sample").agg(
        F.count("*").alias("n_unique"), F.sum(cnt).alias("n_total"),
        F.count_if(cnt < low).alias("below_unique"), zero(F.sum(F.when(cnt < low, cnt))).alias("below_total"),
        F.count_if(cnt > high).alias("above_unique"), zero(F.sum(F.when(cnt > high, cnt))).alias("above_total"),
    )


def distinct_codes(reads: DataFrame, k: int) -> DataFrame:
    """(code): the distinct canonical k-mers of all samples as numbers, k up to MOST_CODE."""
    if not dna.MIN_K <= k <= MOST_CODE:
        raise ValueError(f"k must be from {dna.MIN_K} to {MOST_CODE} for numbers, not {k}")
    return _bins.count(reads.select(F.lit("").alias("sample"), "seq"), k).select("code")


def task_slots(reads: DataFrame, window, k: int, m: int, clean: bool = False) -> DataFrame:
    """(sample, slot, cnt) of what each task reads.

    A slot's count is how often its k-mers occur, so k-mers are hashed where a
    read lies and added up by slot there; no k-mer is shuffled. A task passes
    on a row for each sample and slot: at its end, while those of its samples
    are HELD at most, else after every block. clean: sequences are texts, and
    k-mers are those of what `dna.clean` leaves of them; that is done by bytes
    here, as an expression it takes longer than all else.
    """
    from .partitioning import rolling_minimizers

    dna.check_m(m, dna.check_k(k))
    parts, size, slots, most = window.partitions, window.window, window.slots, HELD

    def lower(minimizers):
        """The first slots of their partitions."""
        return hashing.xxh64_u32(minimizers) % np.uint64(parts) * np.uint64(size)

    def run(batches):
        number: dict = {}  # of each sample that the task has met
        held = np.zeros(0, np.int64)
        first = lower(np.arange(4**m)) if 4**m <= TABLED else None  # of every minimizer there is

        def told(key, n):
            return pa.RecordBatch.from_arrays([pa.array(list(number), kind).take(pa.array(key // slots)), pa.array(key % slots), pa.array(n)], ["sample", "slot", "cnt"])

        for b in batches:
            samples = b.column(0).dictionary_encode(null_encoding="encode")
            kind = samples.dictionary.type
            of = np.array([number.setdefault(x, len(number)) for x in samples.dictionary.to_pylist()], np.int64)[samples.indices.to_numpy()]

            def keys():
                for rows, words, digits, whole in _batches.kmers(b.column(1), k, _batches.CACHED, clean):  # noqa: B023
                    x = rolling_minimizers(digits, k, m)[whole]
                    slot = hashing.xxh64_words(words) % np.uint64(size) + (lower(x) if first is None else first[x])
                    yield of[rows] * slots + slot.astype(np.int64)  # noqa: B023

            for some in _batches.gathered(keys()):
                key, n = _batches.tally(some, len(number) * slots)
                if len(number) * slots <= most:
                    held = np.pad(held, (0, len(number) * slots - len(held)))
                    held[key] += n
                else:
                    yield told(key, n)
        key = np.flatnonzero(held)
        for at in range(0, len(key), _batches.BLOCK):
            yield told(key[at : at + _batches.BLOCK], held[key[at : at + _batches.BLOCK]])

    schema = StructType([reads.schema["sample"], StructField("slot", LongType()), StructField("cnt", LongType())])
    return reads.select("sample", "seq").mapInArrow(run, schema)


def count_slots(reads: DataFrame, window, k: int, m: int, clean: bool = False) -> DataFrame:
    """(sample, slot, cnt) straight from reads, or texts (clean): what `to_slots` gives of all k-mer counts."""
    return task_slots(reads, window, k, m, clean).groupBy("sample", "slot").agg(F.sum("cnt").alias("cnt"))


def to_slots(counts: DataFrame, window, k: int, m: int) -> DataFrame:
    """(sample, slot, cnt): k-mer counts summed up by hash slot; k-mers of a slot merge."""
    from .partitioning import with_partition

    placed = with_partition(counts, k, m, window.partitions)
    return placed.select("sample", window.slot(F.col("kmer"), F.col("part")).alias("slot"), "cnt").groupBy("sample", "slot").agg(F.sum("cnt").alias("cnt"))
