"""Counting k-mers of up to 31 bases in bins.

A task sorts the k-mers of a block of reads and passes them on in bins: one
row for each sample and bin, of numbers and how often each occurs there. Bins
meet in one shuffle, are sorted by their number where they arrive, and are
added up one after another (those of a batch together), so that a task holds
a batch and a bin at a time. A k-mer's number is mixed by a product that can
be undone; the bin is the upper bits of it, so bins are of one size but for
k-mers that occur in every block, which are one number in each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from ..functions import hashing
from . import _batches

BINS_LOG2 = 10
#: Cells of a matrix made together.
CELLS = 1 << 22
MIX, UNMIX = hashing.P1, np.uint64(pow(int(hashing.P1), -1, 1 << 64))
EDGES = np.arange(1, 1 << BINS_LOG2, dtype=np.uint64) << np.uint64(64 - BINS_LOG2)


def deal(reads: DataFrame, k: int) -> DataFrame:
    """(sample, bin, mixed, times), sorted by bin within partitions: the k-mers of a block, as packed 64-bit and 32-bit numbers."""

    def run(batches):
        for b in batches:
            samples = b.column(0).dictionary_encode(null_encoding="encode")
            number = samples.indices.to_numpy()
            for rows, words, _, _ in _batches.kmers(b.column(1), k):
                mixed, of = words[0] * MIX, number[rows]
                order = np.argsort(of, kind="stable")
                mixed, cuts = mixed[order], np.flatnonzero(np.diff(of[order])) + 1
                out = [[], [], [], []]
                for i, part in zip(of[order[np.concatenate([[0], cuts])]], np.split(mixed, cuts), strict=True):
                    x, n = np.unique(part, return_counts=True)
                    ends = np.concatenate([[0], np.searchsorted(x, EDGES), [len(x)]])
                    bins = np.flatnonzero(np.diff(ends))
                    n = n.astype(np.uint32)
                    for values, new in zip(out, (np.full(len(bins), i), bins, [x[ends[j] : ends[j + 1]].tobytes() for j in bins], [n[ends[j] : ends[j + 1]].tobytes() for j in bins]), strict=True):
                        values.extend(new)
                yield pa.RecordBatch.from_arrays([samples.dictionary.take(pa.array(out[0])), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], ["sample", "bin", "mixed", "times"])

    schema = StructType([reads.schema["sample"], StructField("bin", IntegerType()), StructField("mixed", BinaryType()), StructField("times", BinaryType())])
    return reads.select("sample", "seq").mapInArrow(run, schema).repartition("bin").sortWithinPartitions("bin")


def whole_bins(batches):
    """(sample column, mixed, times, k-mers of each row) of rows of whole bins, those of a batch together."""
    held: list = []

    def opened(b):
        flat = lambda i, kind: np.frombuffer(b"".join(b.column(i).to_pylist()), kind)
        return b.column(0).combine_chunks(), flat(2, np.uint64), flat(3, np.uint32), np.array([len(x) for x in b.column(3).to_pylist()], np.int64) // 4

    for b in batches:
        if not b.num_rows:
            continue
        bins = b.column(1).to_numpy()
        if held and bins[0] != held[-1].column(1)[-1].as_py():
            yield opened(pa.Table.from_batches(held))
            held = []
        last = int(np.searchsorted(bins, bins[-1]))
        if last:
            yield opened(pa.Table.from_batches([*held, b.slice(0, last)]))
            held = []
        held.append(b.slice(last))
    if held:
        yield opened(pa.Table.from_batches(held))


def codes(mixed: np.ndarray) -> pa.Array:
    return pa.array((mixed * UNMIX).astype(np.int64))


def count(reads: DataFrame, k: int) -> DataFrame:
    """(sample, code, cnt) of every k-mer."""

    def run(batches):
        for column, mixed, times, sizes in whole_bins(batches):
            samples = column.dictionary_encode(null_encoding="encode")
            of = np.repeat(samples.indices.to_numpy(), sizes)
            for i in np.unique(of):
                mine = of == i
                x, n = add_up(mixed[mine], times[mine])
                yield pa.RecordBatch.from_arrays([samples.dictionary.take(pa.array(np.full(len(x), i))), codes(x), pa.array(n)], ["sample", "code", "cnt"])

    return deal(reads, k).mapInArrow(run, StructType([reads.schema["sample"], StructField("code", LongType()), StructField("cnt", LongType())]))


def add_up(mixed: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(mixed)
    mixed = mixed[order]
    first = np.flatnonzero(np.concatenate([[True], mixed[1:] != mixed[:-1]]))
    return mixed[first], np.add.reduceat(times[order], first, dtype=np.int64)


def matrix(reads: DataFrame, samples: list[str], k: int, hard_min: int) -> DataFrame:
    """(code, counts): counts under the minimum are 0, rows without any are left out. reads are of these samples only."""
    names = {s: i for i, s in enumerate(samples)}

    def run(batches):
        for column, mixed, times, sizes in whole_bins(batches):
            of = np.repeat(np.array([names[s] for s in column.to_pylist()], np.int64), sizes)
            order = np.argsort(mixed)
            mixed, times, of = mixed[order], times[order], of[order]
            first = np.concatenate([[True], mixed[1:] != mixed[:-1]])
            row, mixed = np.cumsum(first) - 1, mixed[first]
            step = max(1, CELLS // len(samples))
            for at in range(0, len(mixed), step):
                low, high = np.searchsorted(row, [at, at + step])
                rows = min(step, len(mixed) - at)
                cells = np.bincount((row[low:high] - at) * len(samples) + of[low:high], times[low:high], rows * len(samples)).astype(np.int64).reshape(rows, -1)
                cells[cells < hard_min] = 0
                some = cells.any(axis=1)
                cells = cells[some]
                arrays = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, len(samples)), pa.int32()), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([codes(mixed[at : at + rows][some]), arrays], ["code", "counts"])

    return deal(reads, k).mapInArrow(run, StructType([StructField("code", LongType()), StructField("counts", ArrayType(LongType()))]))
