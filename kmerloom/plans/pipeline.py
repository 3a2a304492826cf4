"""A whole run: reads to counts to a matrix of some mode, into a run directory."""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna, hashing
from ..operators import counting, merging, partitioning, reshaping
from ..sources.kff import kff_files
from ..sources.reads import read_samples
from ..sources.store import RunStore

MODES = ("kmer:count:bin", "kmer:count:text", "kmer:pa:bin", "kmer:pa:text", "hash:count:bin", "hash:count:text", "hash:pa:bin", "hash:pa:text", "hash:bf:bin", "hash:bfc:bin", "hash:bft:bin")
STAGES = ("repart", "superk", "count", "merge")
#: The least number of partitions, and the letters that one of an automatic number stands for.
LEAST_PARTITIONS, PARTITION_LETTERS = 4, 256_000_000


@dataclass
class Options:
    """partitions: 0 for a number that follows the input. restrict_to lists partitions, restrict_share is a random share of them.

    soft_min may be a share (float), from which each sample's threshold is
    computed. require, exclude and without_refs filter BAM records.
    """

    k: int = 31
    m: int = 10
    mode: str = "kmer:count:bin"
    hard_min: int = 2
    soft_min: int | float | list[int] = 1
    recurrence_min: int = 1
    share_min: int = 0
    bloom_size: int = 10_000_000
    bucket_width: int = 2
    partitions: int = LEAST_PARTITIONS
    restrict_to: list[int] = field(default_factory=list)
    restrict_share: float = 0.0
    until: str = "merge"
    histogram: bool = False
    bounds: tuple[int, int] = counting.HISTOGRAM
    vectors: bool = False
    kff: bool = False
    keep_tmp: bool = False
    codec: str = "zstd"
    plugin: merging.Plugin | None = None
    require: int = 0
    exclude: int = 0
    without_refs: str | list[str] = ""

    def __post_init__(self):
        dna.check_m(self.m, dna.check_k(self.k))
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.until not in STAGES:
            raise ValueError(f"unknown stage {self.until!r}")
        if self.partitions:
            self.partitions = max(LEAST_PARTITIONS, self.partitions)
        if self.mode.startswith("hash:bf") and (self.restrict_to or self.restrict_share):
            raise ValueError("Bloom filters need all partitions")
        if self.restrict_to and self.restrict_share:
            raise ValueError("partitions are restricted by a list or by a share")
        if self.kff and (self.until != "count" or not self.mode.startswith("kmer")):
            raise ValueError("KFF files hold the k-mers of a run until count")
        if self.vectors and not self.mode.startswith("hash"):
            raise ValueError("vectors are made of hash slots")

    @property
    def window(self) -> hashing.HashWindow:
        return hashing.HashWindow(self.bloom_size, self.partitions)


def count(reads: DataFrame, sheet: DataFrame, o: Options) -> tuple[DataFrame, DataFrame]:
    """(all counts, counts at the hard minimum), by k-mer or slot, with the partition."""
    if o.mode.startswith("hash"):
        every = counting.count_slots(reads, o.window, o.k, o.m).withColumn("part", o.window.partition_of(F.col("slot")))
    else:
        every = partitioning.with_partition(counting.count_kmers(reads, o.k), o.k, o.m, o.partitions)
    if o.restrict_to:
        every = partitioning.restrict(every, o.restrict_to, o.partitions)
    return every, at_minimum(every, sheet, o)


def at_minimum(every: DataFrame, sheet: DataFrame, o: Options) -> DataFrame:
    least = F.broadcast(counting.sample_min(sheet, o.hard_min))  # a row for each sample
    return counting.saturate(counting.hard_min(every.join(least, "sample"), F.col("least")).drop("least"))


def soft_thresholds(every: DataFrame, samples: list[str], o: Options) -> list[int]:
    if isinstance(o.soft_min, float):
        spread = every.groupBy("sample", F.col("cnt").alias("abundance")).agg(F.count("*").alias("n_unique"))
        return merging.float_thresholds(spread, o.soft_min, samples)
    return merging.thresholds(o.soft_min, len(samples))


def settle(spark: SparkSession, reads: DataFrame, o: Options, repart_from: str = "") -> Options:
    """Options with all that follows from the input, or from another run whose partitions are used again."""
    if repart_from:
        other = RunStore(spark, repart_from).meta()
        if (other["k"], other["m"]) != (o.k, o.m) or o.partitions not in (0, LEAST_PARTITIONS, other["partitions"]):
            raise ValueError(f"the run at {repart_from} has k {other['k']}, minimizers of {other['m']} and {other['partitions']} partitions")
        o = replace(o, partitions=other["partitions"])
    if not o.partitions:
        letters = reads.agg(F.sum(F.length("seq"))).first()[0] or 0
        o = replace(o, partitions=max(LEAST_PARTITIONS, -(-letters // PARTITION_LETTERS)))
    if o.restrict_share:
        o = replace(o, restrict_to=partitioning.restrict_fraction(o.restrict_share, o.partitions), restrict_share=0.0)
    return o


def run(spark: SparkSession, reads: DataFrame, sheet: DataFrame, path: str, o: Options, repart_from: str = "") -> RunStore:
    """Writes the stages up to `until` and gives the run directory.

    Reads are exploded and counted once: what is needed of counts ahead of the
    minimum, and of the merged matrix ahead of thresholds, is read from tables
    in the run's folder, which go at the end (unless keep_tmp).
    """
    began = time.monotonic()
    o = settle(spark, reads, o, repart_from)
    samples = [r["sample"] for r in sheet.orderBy("sample_idx").collect()]
    store = RunStore(spark, path)
    save = lambda df, name, kind, by=None: store.save(df, name, kind, by, o.codec)
    store.save_meta(k=o.k, m=o.m, partitions=o.partitions, mode=o.mode, samples=samples, bloom_size=o.bloom_size, window=o.window.window, histogram=list(o.bounds), restricted_to=o.restrict_to)

    def done() -> RunStore:
        if not o.keep_tmp:
            for name in tmp:
                store.delete(name)
        store.save_meta("info", seconds=round(time.monotonic() - began, 3), until=o.until)
        return store

    tmp: list[str] = []
    if o.until == "repart":
        save(partitioning.static_repartition(spark, o.m, o.partitions), "repartition", "repartition")
        return done()
    if o.until == "superk":
        save(partitioning.super_kmers(reads, o.k, o.m), "superk", "super_kmers")
        return done()
    hashed = o.mode.startswith("hash")
    key, kind = ("slot", "hash_counts") if hashed else ("kmer", "kmer_counts")
    every, kept = count(reads, sheet, o)
    if o.histogram or isinstance(o.soft_min, float):
        every = save(every, "unfiltered", kind)
        tmp.append("unfiltered")
        kept = at_minimum(every, sheet, o)
    if o.histogram:
        save(counting.histogram(every, o.bounds), "histogram", "histogram")
        save(counting.histogram_totals(every, o.bounds), "histogram_totals", "histogram_totals")
    kept = save(kept, "counts", kind, by="part")
    if o.vectors:
        save(reshaping.sample_vectors(kept.select("sample", "slot"), o.window), "vectors", "bit_vectors")
    if o.kff:
        save(kff_files(kept.select(dna.letters(F.col("kmer")).alias("kmer"), "cnt"), o.k), "kff", "kff")
    if o.until == "count":
        return done()
    soft = soft_thresholds(every, samples, o)
    store.save_meta("merge", soft_min=soft, recurrence_min=o.recurrence_min, share_min=o.share_min)
    merged = save(merging.merge_counts(kept, samples, key), "merged", f"{kind.split('_')[0]}_matrix")
    tmp.append("merged")
    save(merging.merge_statistics(merged, soft, samples, o.share_min), "merge_info", "merge_info")
    matrix = merging.solidify(merged, soft, len(samples), 0 if o.plugin else o.recurrence_min, o.share_min)
    if o.plugin:  # its answer replaces recurrence
        matrix = merging.apply_plugin(matrix, o.plugin, key)
    shape = o.mode.split(":")[1]
    if shape == "bf":
        save(reshaping.false_positive_rates(matrix, o.window, samples), "fpr", "fpr")
        matrix = reshaping.bloom_matrix(matrix, o.window, len(samples))
    elif shape == "bfc":
        matrix = reshaping.counting_bloom_matrix(matrix, o.window, len(samples), o.bucket_width)
    elif shape == "bft":
        matrix = reshaping.per_sample_filters(matrix, samples, o.window)
    elif shape == "pa":
        matrix = reshaping.presence(matrix)
    if o.mode.endswith("text"):
        store.save_text(reshaping.text_lines(matrix, key), "matrix_text")
    else:
        save(matrix, "matrix", "bit_vectors" if shape == "bft" else "hash_matrix" if hashed else "kmer_matrix")
    return done()


def run_sheet(spark: SparkSession, sheet: DataFrame, path: str, o: Options, repart_from: str = "") -> RunStore:
    """A run over the files of a sample sheet, BAM records filtered."""
    found = read_samples(spark, sheet, require=o.require, exclude=o.exclude, without_refs=o.without_refs)
    return run(spark, found, sheet, path, o, repart_from)
