import itertools
import random

import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kmerloom.functions import bits, dna, hashing
from kmerloom.operators.partitioning import with_minimizer

ORDER = "ACTG"


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def canonical(s):
    return min(s, rc(s), key=lambda x: [ORDER.index(c) for c in x])


def slow_minimizer(s, m):
    options = []
    for j in range(len(s) - m + 1):
        x = canonical(s[j : j + m])
        options.append([ORDER.index(c) for c in x] if "AA" not in x[1:] else [3] * m)
    return "".join(ORDER[d] for d in min(options))


def one(spark, value, **columns):
    r = spark.createDataFrame([(value,)], "s string").select(*(c.alias(n) for n, c in columns.items())).first()
    return r


@pytest.mark.parametrize("k", [8, 13, 31, 32, 33, 63, 64, 65, 127])
def test_canonical_and_minimizer(spark, k):
    r = random.Random(k)
    seqs = ["".join(r.choice("ACGT") for _ in range(k)) for _ in range(40)] + ["A" * k, "ACGT" * 40]
    seqs = [s[:k] for s in seqs]
    m = min(6, k)
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    got = df.select("s", dna.canonical(F.col("s")).alias("c"), dna.reverse_complement(F.col("s")).alias("r"), dna.letters(dna.minimizer(dna.canonical_digits(dna.digits(F.col("s"))), k, m)).alias("m")).collect()
    numbers = {r["kmer"]: r["minimizer"] for r in with_minimizer(df.select(dna.canonical_digits(dna.digits(F.col("s"))).alias("kmer")), k, m).collect()}
    number = lambda x: x.translate(str.maketrans("ACTG", "0123"))
    for s, c, rev, mm in got:
        assert numbers[number(c)] == int(number(mm), 4)
        assert c == canonical(s) and rev == rc(s) and mm == slow_minimizer(canonical(s), m)


def test_known_values(spark):
    r = one(spark, "CGCCCCCCCCCCCT", c=dna.canonical(F.col("s")))
    assert r["c"] == "AGGGGGGGGGGGCG"
    assert one(spark, "ACGAGCAATACGA", m=dna.letters(dna.minimizer(dna.digits(F.col("s")), 13, 4)))["m"] == "AATA"
    r = one(spark, "ACTG", c=dna.code(dna.digits(F.col("s"))), d=dna.decode(dna.code(dna.digits(F.col("s"))), 4))
    assert (r["c"], r["d"]) == (0b00011011, "ACTG")


def test_limits():
    for k in (7, 128):
        with pytest.raises(ValueError):
            dna.check_k(k)
    for m in (3, 16):
        with pytest.raises(ValueError):
            dna.check_m(m, 31)


@given(st.lists(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=9), min_size=1, max_size=5), st.integers(0, 2**32))
@settings(max_examples=60, deadline=None)
def test_xxh64(rows, seed):
    n = min(map(len, rows))
    words = [np.array([r[k] for r in rows], np.uint64) for k in range(n)]
    want = [xxhash.xxh64_intdigest(np.array(r[:n], "<u8").tobytes(), seed) for r in rows]
    assert hashing.xxh64_words(words, seed).tolist() == want
    small = np.array([r[0] & 0xFFFFFFFF for r in rows], np.uint32)
    assert hashing.xxh64_u32(small, seed).tolist() == [xxhash.xxh64_intdigest(x.tobytes(), seed) for x in small]


@pytest.mark.parametrize("k", [8, 31, 32, 33, 64, 65, 127])
def test_packing(k):
    r = random.Random(k)
    rows = ["".join(r.choice("0123") for _ in range(k)) for _ in range(5)]
    words = hashing.pack(pd.Series(rows))
    for i, s in enumerate(rows):
        assert sum(int(w[i]) << 64 * j for j, w in enumerate(words)) == int(s, 4)


def test_window():
    w = hashing.HashWindow(40_000, 4)
    assert (w.window, w.slots, w.lower(1), w.upper(1)) == (10_048, 40_192, 10_048, 20_095)


def test_buckets_and_packed_bits(spark):
    for c, width, want in [(0, 8, 0), (3, 8, 2), (4, 8, 3), (32, 2, 3), (32768, 8, 16), (32768, 3, 7)]:
        assert spark.range(1).select(bits.log2_bucket(F.lit(c).cast("bigint"), width).alias("b")).first()["b"] == want
    assert [bits.packed_bytes(*x) for x in ((10, 5), (10, 2), (8, 2), (100, 0))] == [7, 3, 2, 0]
    got = spark.createDataFrame([([1, 0, 0, 0, 0, 0, 0, 1, 1],)], "b array<int>").select(bits.pack_bits(F.col("b")).alias("p")).first()["p"]
    assert bytes(got) == bytes([0b10000001, 1])


def test_estimate_of_a_full_filter(spark):
    got = spark.range(3).select(bits.bloom_cardinality(F.lit(2.0), F.col("id")).alias("n"))
    assert [r["n"] for r in got.orderBy("n").collect()] == [0.0, pytest.approx(2 * np.log(2)), float("inf")]


def test_every_valid_minimizer_has_no_inner_aa(spark):
    rows = ["".join(x) for x in itertools.product("0123", repeat=5)]
    got = spark.createDataFrame([(r,) for r in rows], "s string").select("s", dna.valid_minimizer(F.col("s")).alias("v")).collect()
    assert all(v == ("00" not in s[1:]) for s, v in got)


def test_clean(spark):
    """Only A, C, G, T and a, c, g, t are bases, as in SQL: not the two capitals that some letters have."""
    assert one(spark, "xACg\u1e97t\u1e9aN\ufb05\ufb06\u0131\u017f-a", seq=dna.clean(F.col("s")))["seq"] == "ACGTA"
