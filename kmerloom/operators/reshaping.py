"""Presence, Bloom and counting-Bloom matrices; text forms; per-sample filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bits, dna
from ._dense import fill


def presence(matrix: DataFrame) -> DataFrame:
    """Counts as 0 and 1."""
    return matrix.withColumn("counts", F.transform("counts", lambda c: (c > 0).cast("bigint")))


def densify(matrix: DataFrame, window, n_samples: int) -> DataFrame:
    """A row for every slot of the windows; rows of zeros where the matrix has none. For sinks: inside, matrices stay sparse."""
    zeros = F.array_repeat(F.lit(0).cast("bigint"), n_samples)
    slots = matrix.sparkSession.range(window.slots).select(F.col("id").alias("slot"))
    return slots.join(matrix, "slot", "left").select("slot", F.coalesce("counts", zeros).alias("counts"))


def bloom_matrix(matrix: DataFrame, window, n_samples: int) -> DataFrame:
    return densify(presence(matrix), window, n_samples)


def counting_bloom_matrix(matrix: DataFrame, window, n_samples: int, width: int = 2) -> DataFrame:
    bucketed = matrix.withColumn("counts", F.transform("counts", lambda c: bits.log2_bucket(c, width)))
    return densify(bucketed, window, n_samples)


def per_sample_slots(matrix: DataFrame, samples: list[str]) -> DataFrame:
    """(sample, slot) of set slots: the transposed Bloom matrix in its sparse form."""
    cells = matrix.select("slot", F.posexplode("counts").alias("i", "c")).where("c > 0")
    return cells.select(F.get(F.array(*map(F.lit, samples)), F.col("i")).alias("sample"), "slot")


def sample_vectors(slots: DataFrame, window) -> DataFrame:
    """(sample, part, words) of (sample, slot) rows: a sample's set slots as signed 64-bit words of one window, bit i of a word for slot 64 w + i.

    A word is a union of powers of two (bit_or), so grouping is partial; a
    window's words are the largest group, of a fixed size, and are laid out in
    a time that is in proportion to them.
    """
    size = window.window // 64
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("slot", F.lit(64)).cast("int"))
    words = slots.groupBy("sample", F.floor(F.col("slot") / 64).alias("w")).agg(F.bit_or(bit).alias("word"))
    placed = words.select("sample", F.floor(F.col("w") / size).cast("int").alias("part"), F.pmod("w", F.lit(size)).alias("w"), "word")
    return fill(placed, ["sample", "part"], F.col("w"), F.col("word"), size, "words")


def per_sample_filters(matrix: DataFrame, samples: list[str], window) -> DataFrame:
    """(sample, part, words): a sample's filter over every partition's window that holds a slot of it; see `sample_vectors`."""
    return sample_vectors(per_sample_slots(matrix, samples), window)


def vector_slots(vectors: DataFrame, window) -> DataFrame:
    """(sample, slot) of the set bits of stored vectors."""
    words = vectors.select("sample", "part", F.posexplode("words").alias("w", "word")).where("word <> 0")
    first = F.col("part").cast("bigint") * window.window + F.col("w") * 64
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda j: F.call_function("shiftrightunsigned", F.col("word"), j).bitwiseAND(F.lit(1)) == 1)
    return words.select("sample", F.explode(F.transform(bits, lambda j: first + j)).alias("slot"))


def text_lines(matrix: DataFrame, key: str = "kmer") -> DataFrame:
    """(line): key and counts, separated by spaces."""
    shown = dna.letters(F.col(key)) if key == "kmer" else F.col(key).cast("string")
    return matrix.select(F.concat_ws(" ", shown, F.array_join(F.transform("counts", lambda c: c.cast("string")), " ")).alias("line"))


def false_positive_rates(matrix: DataFrame, window, samples: list[str]) -> DataFrame:
    """(part, sample, fpr): the rate of each partition's window from its set slots."""
    cells = per_sample_slots(matrix, samples).groupBy(window.partition_of(F.col("slot")).alias("part"), "sample").agg(F.count("*").alias("n"))
    return cells.select("part", "sample", F.round(bits.bloom_fpr(F.lit(float(window.window)), F.col("n")), 6).alias("fpr"))


def cardinalities(matrix: DataFrame, window, samples: list[str]) -> DataFrame:
    """(sample, set_slots, estimate): keys of each sample estimated from its set slots."""
    cells = per_sample_slots(matrix, samples).groupBy("sample").agg(F.count("*").alias("set_slots"))
    return cells.select("sample", "set_slots", F.round(bits.bloom_cardinality(F.lit(float(window.slots)), F.col("set_slots")), 3).alias("estimate"))
