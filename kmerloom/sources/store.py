"""Run directories: Parquet datasets with their parameters, on any path that Spark reaches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("repartition", "super_kmers", "kmer_counts", "hash_counts", "kmer_matrix", "hash_matrix", "bit_vectors", "kff", "histogram", "histogram_totals", "merge_info", "fpr", "text")


class RunStore:
    """A folder with a dataset for each stage and `_meta` for the parameters that later runs must share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save_meta(self, name: str = "run", **meta) -> None:
        self.spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/_meta_{name}")

    def meta(self, name: str = "run") -> dict:
        """What the run was made with ("run"), its thresholds ("merge") or its time and rows ("info")."""
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/_meta_{name}").collect()))

    def save(self, df: DataFrame, name: str, kind: str, by: str | None = None, codec: str = "zstd") -> DataFrame:
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}")
        writer = df.write.mode("overwrite").option("compression", codec)
        (writer.partitionBy(by) if by else writer).parquet(f"{self.path}/{name}")
        self.spark.createDataFrame([(json.dumps({"kind": kind}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/_kind_{name}")
        return self.load(name)

    def delete(self, name: str) -> None:
        """Removes a dataset that nothing reads any more."""
        for path in (f"{self.path}/{name}", f"{self.path}/_kind_{name}"):
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def save_text(self, lines: DataFrame, name: str) -> None:
        lines.write.mode("overwrite").text(f"{self.path}/{name}")

    def kind(self, name: str) -> str:
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/_kind_{name}").collect()))["kind"]

    def load(self, name: str, parts: list[int] | None = None) -> DataFrame:
        """A dataset, or some of its partition folders (others are not opened)."""
        df = self.spark.read.parquet(f"{self.path}/{name}")
        return df.where(F.col("part").isin(parts)) if parts is not None else df

    def dump(self, name: str, key: str = "kmer") -> DataFrame:
        """(line) of a counts, matrix or histogram dataset as text."""
        from ..functions import dna
        from ..operators.reshaping import text_lines

        kind, df = self.kind(name), self.load(name)
        if kind.endswith("_matrix"):
            return text_lines(df, "kmer" if kind.startswith("kmer") else "slot")
        if kind == "kmer_counts":
            return df.select(F.concat_ws(" ", dna.letters(F.col("kmer")), F.col("cnt").cast("string")).alias("line"))
        if kind == "hash_counts":
            return df.select(F.concat_ws(" ", F.col("slot").cast("string"), F.col("cnt").cast("string")).alias("line"))
        if kind == "histogram":
            return df.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in ("sample", "abundance", "n_unique", "n_total"))).alias("line"))
        raise ValueError(f"a {kind} dataset has no text form")

    def histogram_lines(self, sample: str, total: bool = False) -> list[str]:
        """One sample's histogram as text: bounds, what lies outside, then every abundance within; distinct keys, or (total) occurrences."""
        what = "total" if total else "unique"
        low, high = self.meta()["histogram"]
        found = {r["abundance"]: r["n_total" if total else "n_unique"] for r in self.load("histogram").where(F.col("sample") == sample).collect()}  # a row for each abundance within bounds
        out = self.load("histogram_totals").where(F.col("sample") == sample).first()
        below, above = (out[f"below_{what}"], out[f"above_{what}"]) if out else (0, 0)
        return [f"@LOWER={low}", f"@UPPER={high}", f"@OOB_L={below}", f"@OOB_U={above}", *(f"{a} {found.get(a, 0)}" for a in range(low, high + 1))]

    def check_same(self, other: RunStore) -> None:
        """Runs can be combined if k, minimizer size and partitions are equal."""
        a, b = self.meta(), other.meta()
        wrong = [x for x in ("k", "m", "partitions", "mode") if a.get(x) != b.get(x)]
        if wrong:
            raise ValueError(f"runs differ in {', '.join(wrong)}")
