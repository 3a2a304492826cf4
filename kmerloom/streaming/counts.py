"""K-mer counts of reads that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.counting import explode_kmers


def running_counts(reads: DataFrame, k: int) -> DataFrame:
    """(sample, kmer, cnt) over all reads so far, for update or complete output; state holds a row for each sample and k-mer."""
    return explode_kmers(reads, k, "sample").groupBy("sample", "kmer").agg(F.count("*").alias("cnt"))


def windowed_counts(reads: DataFrame, k: int, window: str, late: str, slide: str | None = None) -> DataFrame:
    """(start, sample, kmer, cnt) by time window of column ts; windows close, and their state goes, once the watermark has passed them."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    kmers = explode_kmers(reads.withWatermark("ts", late), k, "sample", "ts")
    return kmers.groupBy(span.alias("w"), "sample", "kmer").agg(F.count("*").alias("cnt")).select(F.col("w.start").alias("start"), "sample", "kmer", "cnt")


def append_batches(reads: DataFrame, k: int, path: str, checkpoint: str):
    """Writes each batch's counts under its number, so that a batch done again replaces itself; `total_counts` sums them up."""

    def put(batch: DataFrame, number: int) -> None:
        running_counts(batch, k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return reads.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def total_counts(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("sample", "kmer").agg(F.sum("cnt").alias("cnt"))
