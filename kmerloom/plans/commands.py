"""Commands over run directories: filter by a sample, combine, aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import combining, filtering, merging, partitioning
from ..sources.store import RunStore
from . import pipeline

OUTPUTS = ("matrix", "vector", "key")


def _key(store: RunStore) -> str:
    return "slot" if store.meta()["mode"].startswith("hash") else "kmer"


def _presence(store: RunStore) -> bool:
    return store.meta()["mode"].split(":")[1] != "count"


def as_run(store: RunStore) -> combining.Run:
    """What can be combined of a stored run: its matrix or, of a run until count, its counts with a column for each sample."""
    meta, key = store.meta(), _key(store)
    if store.meta("info")["until"] == "count":
        matrix = merging.merge_counts(store.load("counts"), meta["samples"], key)
    else:
        matrix = store.load("matrix")
    return combining.Run(matrix.select(key, "counts"), meta["samples"], meta["k"], meta["m"], meta["partitions"], key)


def filter_run(store: RunStore, reads: DataFrame, sheet: DataFrame, path: str, hard_min: int = 1, outputs: tuple[str, ...] = OUTPUTS) -> RunStore:
    """A stored matrix filtered by one new sample, which is counted as the run's samples were.

    matrix: rows that the sample holds (its count behind them, unless they are
    presences); vector: its count, or presence, for every row; key: its keys that the matrix lacks.
    """
    if wrong := set(outputs) - set(OUTPUTS):
        raise ValueError(f"unknown outputs {sorted(wrong)}")
    meta, name = store.meta(), _key(store)
    if meta["mode"].split(":")[1] not in ("count", "pa"):
        raise ValueError("Bloom filters are not filtered")
    sample = filtering.single_sample(reads, [r["sample"] for r in sheet.collect()])
    o = pipeline.Options(k=meta["k"], m=meta["m"], mode=meta["mode"], hard_min=hard_min, partitions=meta["partitions"], bloom_size=meta["bloom_size"], restrict_to=meta["restricted_to"])
    out = RunStore(store.spark, path)
    presence = _presence(store)
    out.save_meta(**(meta | {"samples": meta["samples"] if presence else [*meta["samples"], sample]}))
    key = out.save(pipeline.count(reads, sheet, o)[1], "counts", f"{'hash' if name == 'slot' else 'kmer'}_counts", by="part").select(name, "cnt")
    matrix, kind = store.load("matrix"), store.kind("matrix")
    if "matrix" in outputs:
        out.save(filtering.rows_in_key(matrix, key, not presence, name), "matrix", kind)
    if "vector" in outputs:
        vector = filtering.key_vector(matrix, key, presence, name)
        out.save(vector.select(name, F.array("value").alias("counts")), "vector", kind)
    if "key" in outputs:
        out.save(filtering.absent_from_matrix(matrix, key, name).withColumn("sample", F.lit(sample)), "key", f"{'hash' if name == 'slot' else 'kmer'}_counts")
    out.save_meta("info", until="filter")
    return out


def combine_runs(stores: list[RunStore], path: str) -> RunStore:
    """One run of several, with the columns of all; they must agree in k, minimizer size, partitions and mode."""
    for other in stores[1:]:
        stores[0].check_same(other)
    combined = combining.combine([as_run(s) for s in stores])
    out = RunStore(stores[0].spark, path)
    out.save_meta(**(stores[0].meta() | {"samples": combined.samples}))
    out.save(combined.matrix, "matrix", "hash_matrix" if combined.key == "slot" else "kmer_matrix")
    out.save_meta("info", until="merge")
    return out


def aggregate_run(store: RunStore, name: str = "matrix", parts: list[int] | None = None, ordered: bool = False, count: bool = True) -> DataFrame:
    """All partitions of a stored dataset in one table, in order of keys if asked for; count: with its counts."""
    return combining.aggregate([store.load(name, parts)], count, ordered, _key(store))


def partition_info(store: RunStore) -> DataFrame:
    """(part, n_kmers) of stored counts."""
    return partitioning.partition_sizes(store.load("counts"))
