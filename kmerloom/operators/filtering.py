"""A matrix filtered by the k-mers (or, by name, the slots) of one more sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows_in_key(matrix: DataFrame, key: DataFrame, with_count: bool = True, name: str = "kmer") -> DataFrame:
    """Rows whose k-mer the key holds; its count becomes the last place of counts (not for presence matrices)."""
    if not with_count:
        return matrix.join(key, name, "left_semi")
    return matrix.join(key.select(name, F.col("cnt").alias("key_cnt")), name).select(name, F.concat("counts", F.array(F.col("key_cnt"))).alias("counts"))


def key_vector(matrix: DataFrame, key: DataFrame, presence: bool = False, name: str = "kmer") -> DataFrame:
    """(kmer, value) of every matrix row: the key's count (or 1), 0 where it has none."""
    value = F.col("key_cnt") if not presence else F.col("key_cnt").isNotNull().cast("bigint")
    return matrix.select(name).join(key.select(name, F.col("cnt").alias("key_cnt")), name, "left").select(name, F.coalesce(value, F.lit(0)).cast("bigint").alias("value"))


def absent_from_matrix(matrix: DataFrame, key: DataFrame, name: str = "kmer") -> DataFrame:
    """(kmer, cnt) of the key's k-mers that the matrix lacks."""
    return key.join(matrix, name, "left_anti").select(name, "cnt")


def single_sample(key: DataFrame, samples: list[str]) -> str:
    if len(samples) != 1:
        raise ValueError("the key must be one sample")
    return samples[0]
