"""Presence bits, logarithmic buckets and Bloom filter estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log2_bucket(count: Column, width: int) -> Column:
    """0 for 0, else the number of bits of the count, at most 2^width - 1."""
    return F.when(count <= 0, F.lit(0)).otherwise(F.least(F.length(F.bin(count)), F.lit((1 << width) - 1))).cast("bigint")


def packed_bytes(n: int, width: int) -> int:
    return (n * width + 7) >> 3


def pack_bits(bits: Column) -> Column:
    """An array of 0 and 1 as binary, least significant bit first, a byte for eight."""
    n = F.size(bits)
    byte = lambda b: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda a, j: a + F.coalesce(F.get(bits, b * 8 + j).cast("int"), F.lit(0)) * F.pow(F.lit(2), j).cast("int"))
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / 8) - 1, F.lit(0)).cast("int")), lambda b: F.lpad(F.hex(byte(b)), 2, "0")), ""))


def bloom_fpr(slots: Column, n: Column, hashes: int = 1) -> Column:
    """False-positive rate of a filter of so many slots that holds n keys."""
    return F.pow(1 - F.exp(-(n * hashes) / slots), F.lit(float(hashes)))


def bloom_cardinality(slots: Column, set_slots: Column, hashes: int = 1) -> Column:
    """Estimated number of keys of a filter from its set slots; infinite for a full one (Spark's logarithm of 0 is null)."""
    return F.when(set_slots == slots, F.lit(float("inf"))).otherwise(-(slots / F.lit(float(hashes))) * F.ln(1 - set_slots / slots))
