"""Combining and listing matrices of several runs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merging import WIDE


@dataclass
class Run:
    """A matrix (key, counts) with its samples in order, and what must be equal between runs."""

    matrix: DataFrame
    samples: list[str]
    k: int
    m: int
    partitions: int
    key: str = "kmer"


def counts_run(counts: DataFrame, sample: str, k: int, m: int, partitions: int, key: str = "kmer") -> Run:
    """A run that has counts only gives one column for each sample."""
    return Run(counts.select(key, F.array(F.col("cnt")).alias("counts")), [sample], k, m, partitions, key)


def sample_names(runs: list[Run]) -> list[str]:
    """Names of all runs in order; a name met before gets its run's number."""
    seen, out = set(), []
    for i, run in enumerate(runs):
        for s in run.samples:
            name = f"{s}_{i}" if s in seen else s
            seen.add(name)
            out.append(name)
    return out


def combine(runs: list[Run]) -> Run:
    """One matrix over all runs, columns in run order; keys of any run are kept, absent cells are 0.

    One aggregation by key over the union of all runs, each row padded to the
    full width; never a join for each run. Up to WIDE columns are aggregated as
    numbers, by hash; as arrays they would be sorted by key, twice.
    """
    first = runs[0]
    if any((r.k, r.m, r.partitions, r.key) != (first.k, first.m, first.partitions, first.key) for r in runs):
        raise ValueError("runs must agree in k, minimizer size, partitions and key")
    parts = [r.matrix.select(first.key, F.lit(i).alias("run"), "counts") for i, r in enumerate(runs)]
    union = reduce(DataFrame.unionByName, parts)
    of = lambda i, x: F.when(F.col("run") == i, x)
    zero = F.lit(0).cast("bigint")
    if sum(len(r.samples) for r in runs) <= WIDE:
        counts = F.array(*(F.coalesce(F.max(of(i, F.get("counts", F.lit(j)))), zero) for i, r in enumerate(runs) for j in range(len(r.samples))))
    else:
        counts = F.concat(*(F.coalesce(F.first(of(i, F.col("counts")), ignorenulls=True), F.array_repeat(zero, len(r.samples))) for i, r in enumerate(runs)))
    matrix = union.groupBy(first.key).agg(counts.alias("counts"))
    return Run(matrix, sample_names(runs), first.k, first.m, first.partitions, first.key)


def aggregate(parts: list[DataFrame], count: bool = True, ordered: bool = False, key: str = "kmer") -> DataFrame:
    """Rows of all parts; keys only if not count; in the order A < C < T < G if ordered (k-mers are digits, whose order is that)."""
    rows = reduce(DataFrame.unionByName, parts)
    rows = rows if count else rows.select(key)
    return rows.orderBy(key) if ordered else rows
