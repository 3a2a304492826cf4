import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kmerloom.functions import dna
from kmerloom.operators import combining, counting, filtering, merging, partitioning, reshaping

from .test_dna import canonical

ABC = ["a", "b", "c"]


def reads(spark, rows):
    return spark.createDataFrame([(s, q, i) for i, (s, q) in enumerate(rows)], "sample string, seq string, read_id long")


def slow_counts(rows, k):
    out = Counter()
    for s, q in rows:
        q = (q or "").upper()
        for i in range(len(q) - k + 1):
            x = q[i : i + k]
            if set(x) <= set("ACGT"):
                out[s, canonical(x)] += 1
    return out


def some_reads(n=60, seed=1):
    r = random.Random(seed)
    rows = [(r.choice(ABC), "".join(r.choice("ACGTacgtN" if i % 5 == 0 else "ACGT") for _ in range(r.randrange(5, 90)))) for i in range(n)]
    return [*rows, ("a", None), ("b", ""), ("c", "A" * 3000), ("a", "NNNN"), ("b", rows[0][1]), ("c", "ACGT" * 10)]


@pytest.mark.parametrize("k", [8, 9, 32, 33, 65])
def test_counts(spark, k):
    rows = some_reads()
    got = {(s, x): n for s, x, n in counting.count_kmers(reads(spark, rows), k).select("sample", dna.letters(F.col("kmer")), "cnt").collect()}
    slow = slow_counts(rows, k)
    assert got == dict(slow)
    fused = merging.columns(merging.count_matrix(reads(spark, rows), ABC, k, 2), ABC).collect()
    want = {x: tuple(n if (n := slow.get((s, x), 0)) >= 2 else 0 for s in ABC) for _, x in got}
    assert {r[0]: tuple(r[1:]) for r in fused} == {x: c for x, c in want.items() if any(c)}


@pytest.mark.parametrize("k, m, slots", [(8, 4, 100), (21, 8, 40_000), (31, 10, 5_000_000), (32, 8, 1000), (33, 9, 1000), (65, 15, 1000), (96, 8, 1000)])
def test_slots_of_reads_are_those_of_counts(spark, k, m, slots):
    from kmerloom.functions.hashing import HashWindow

    df, w = reads(spark, [*some_reads(), (None, "ACGTTGCA" * 20)]), HashWindow(slots, 4)
    pairs = lambda c: Counter({(r["sample"], r["slot"]): r["cnt"] for r in c.collect()})
    direct = counting.count_slots(df, w, k, m)
    assert pairs(direct) == pairs(counting.to_slots(counting.count_kmers(df, k), w, k, m)) and direct.count()
    assert "kmer" not in direct._jdf.queryExecution().executedPlan().toString()  # no k-mer is shuffled


def test_slots_of_texts(spark):
    """Cut to bases by bytes, with what `dna.clean` leaves of them; m = 15 has more minimizers than a task lists."""
    from kmerloom.functions.hashing import HashWindow

    texts = ["An Act, Catching gates\u2026 TAG-TAG\u00e9tat\u0000ga\n" * 20, "ACGT\u1e97TTGC\u1e9aACG\ufb05TGAC\ufb06catgactga" * 9, "--NN--\u00ff" * 5, "", None, "acgt", "t" * 40, "-" + "aCgT" * 30 + "-"]
    df, w = reads(spark, [(s, t) for t in texts for s in ("A", None)]), HashWindow(1000, 4)
    pairs = lambda c: Counter({(r["sample"], r["slot"]): r["cnt"] for r in c.collect()})
    for k, m in ((21, 8), (31, 15), (40, 10)):
        got = pairs(counting.count_slots(df, w, k, m, clean=True))
        assert got == pairs(counting.count_slots(df.select("sample", dna.clean(F.col("seq")).alias("seq")), w, k, m)) and got
        assert got != pairs(counting.count_slots(df, w, k, m))  # where other characters end a run


def test_minimizers_of_a_sequence():
    import numpy as np

    from kmerloom.operators import _batches

    r = random.Random(4)
    d = np.array([r.choice([0, 0, 1, 2, 3]) for _ in range(400)] + [4] + [0] * 30 + [1, 2, 3] * 20, np.uint8)
    for k, m in ((8, 4), (21, 8), (21, 10), (33, 15), (15, 15)):
        number = lambda x: int("".join(map(str, x)), 4)

        def worth(x, m=m, number=number):
            x = min(number(x), number([c ^ 2 for c in reversed(x)]))
            text = np.base_repr(x, 4).zfill(m)
            return 4**m - 1 if "00" in text[1:] else x

        want = [-1 if 4 in q else min(worth(q[j : j + m]) for j in range(k - m + 1)) for q in (d[i : i + k].tolist() for i in range(len(d) - k + 1))]
        assert partitioning.window_minimizers(d, k, m).tolist() == want
    some = [np.arange(n) for n in (3, 0, 5, 4, 1)]
    assert [x.tolist() for x in _batches.gathered(some, 8)] == [[0, 1, 2, 0, 1, 2, 3, 4], [0, 1, 2, 3, 0]] and not list(_batches.gathered([]))


def test_a_task_passes_on_a_slot_once(spark, monkeypatch):
    """Whatever the batches that its reads come in; slots of too many samples to be held are as many as blocks give."""
    from kmerloom.functions.hashing import HashWindow

    df, w, size = reads(spark, [*some_reads(), (None, "ACGTTGCA" * 20)]).coalesce(1), HashWindow(1000, 4), "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, "7")
    try:
        held = counting.task_slots(df, w, 21, 8).collect()
        monkeypatch.setattr(counting, "HELD", 2 * w.slots)
        some = counting.task_slots(df, w, 21, 8).collect()
    finally:
        spark.conf.unset(size)
    assert len(held) == len({(r["sample"], r["slot"]) for r in held}) < len(some)
    total = Counter()
    for r in some:
        total[r["sample"], r["slot"]] += r["cnt"]
    assert {(r["sample"], r["slot"]): r["cnt"] for r in held} == total


@pytest.mark.parametrize("n", [2, 70])
def test_keys_of_other_samples(spark, n):
    counts = spark.createDataFrame([("s0", 1, 5), ("s1", 1, 6), ("x", 1, 7), ("x", 2, 8), (None, 3, 9)], "sample string, slot long, cnt long")
    rows = lambda every: {r["slot"]: r["counts"] for r in merging.merge_counts(counts, [f"s{i}" for i in range(n)], "slot", every).collect()}
    assert rows(False) == {1: [5, 6, *[0] * (n - 2)]} and rows(True) == rows(False) | {2: [0] * n, 3: [0] * n}


def test_runs_are_combined_by_hash(spark):
    run = lambda samples, rows: combining.Run(spark.createDataFrame(rows, "kmer string, counts array<long>"), samples, 21, 8, 4)
    for n in (1, 70):
        m = combining.combine([run(["a", *(f"x{i}" for i in range(n - 1))], [("0", [1] * n), ("1", [2] * n)]), run(["b"], [("1", [3]), ("2", [4])])]).matrix
        assert {r[0]: r[1] for r in m.collect()} == {"0": [1] * n + [0], "1": [2] * n + [3], "2": [0] * n + [4]}
        assert ("SortAggregate" in m._jdf.queryExecution().executedPlan().toString()) == (n > 64)


def test_blocks_of_reads():
    import pyarrow as pa

    from kmerloom.operators import _batches

    seqs = [q for _, q in some_reads(20, 3)]
    for k in (8, 21, 40):
        whole = [(r, *(int(w[i]) for w in words)) for rows, words, _, _ in _batches.kmers(pa.array(seqs), k) for i, r in enumerate(rows)]
        assert whole == [(r, *(int(w[i]) for w in words)) for rows, words, _, _ in _batches.kmers(pa.array(seqs), k, 7) for i, r in enumerate(rows)]
        assert Counter(r for r, *_ in whole) == {i: n for i, q in enumerate(seqs) if (n := sum(slow_counts([("a", q)], k).values()))}


def test_kmers_are_dealt_in_bins(spark):
    """One shuffle of few rows, whatever the batches that bins and reads come in; a null sample is one of its own."""
    from kmerloom.operators import _bins

    rows = [*some_reads(), *((x, "ACGT" * 50) for x in (*ABC, None))]
    df = reads(spark, rows).repartition(3)
    want = {(s, x.translate(str.maketrans("ACTG", "0123"))): n for (s, x), n in slow_counts(rows, 11).items()}
    for size in ("1", "3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = counting.count_kmers(df, 11).collect()
        assert {(r["sample"], r["kmer"]): r["cnt"] for r in got} == want and len(got) == len(want)
        found = [r["code"] for r in counting.distinct_codes(df, 11).collect()]
        assert len(found) == len(set(found)) == len({x for _, x in want})
        m = {r["kmer"]: tuple(r["counts"]) for r in merging.count_matrix(df, ["c", "a"], 11, 2).collect()}
        two = {x: tuple(n if (n := want.get((s, x), 0)) > 1 else 0 for s in "ca") for _, x in want}
        assert m == {x: c for x, c in two.items() if any(c)}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert _bins.deal(df, 11).count() < sum(want.values())
    assert not counting.count_kmers(df.where("false"), 11).count()


@pytest.mark.parametrize("k, m", [(8, 4), (21, 8), (31, 11), (31, 15)])
def test_mmers_of_kmers(spark, k, m):
    want = Counter(canonical(x[j : j + m]) for x in {x for _, x in slow_counts(some_reads(), k)} for j in range(k - m + 1))
    got = partitioning.count_mmers(counting.distinct_codes(reads(spark, some_reads()), k), k, m).collect()
    assert {r["mmer"]: r["n"] for r in got} == {int(x.translate(str.maketrans("ACTG", "0123")), 4): n for x, n in want.items()} and len(got) == len(want)


def test_computed_thresholds_read_one_shuffle(spark):
    r = random.Random(2)
    rows = {f"{i:05d}": tuple(r.choice([0, 0, 1, 1, 2, 3, 300]) for _ in ABC) for i in range(200)}
    m = matrix(spark, {x: (*c, 0) for x, c in rows.items()})
    cells_ = Counter((s, c) for row in rows.values() for s, c in zip(ABC, row, strict=True) if c)
    h = spark.createDataFrame([(s, c, n) for (s, c), n in cells_.items()], "sample string, abundance bigint, n_unique bigint")
    for share in (0.0, 0.5, 0.9, 0.99, 1.0):
        want = merging.float_thresholds(h, share, [*ABC, "d"])
        row = merging.float_threshold_row(m, share, [*ABC, "d"])
        assert row.first()["soft"] == want
        assert cells(merging.solidify(m, row, 4)) == cells(merging.solidify(m, want, 4))
    every = merging.count_matrix(reads(spark, some_reads()), ABC, 11, 1)
    held = merging.solidify(every, merging.float_threshold_row(every, 0.5, ABC), 3)
    assert held.collect() and "ReusedExchange" in held._jdf.queryExecution().executedPlan().toString()


def matrix(spark, rows):
    return spark.createDataFrame([(x, list(c)) for x, c in rows.items()], "kmer string, counts array<bigint>")


def cells(df):
    return {r["kmer"]: tuple(r["counts"]) for r in df.collect()}


def test_rescue_and_recurrence(spark):
    m = matrix(spark, {"00": (5, 4, 1), "01": (5, 1, 1), "02": (0, 0, 9), "03": (1, 1, 1)})
    assert cells(merging.solidify(m, 3, 3, share_min=2)) == {"00": (5, 4, 1), "01": (5, 0, 0), "02": (0, 0, 9)}
    # rescued cells do not count for recurrence
    assert cells(merging.solidify(m, 3, 3, recurrence_min=2, share_min=1)) == {"00": (5, 4, 1)}
    # an absent cell is never solid, whatever the threshold
    assert cells(merging.solidify(m, 0, 3, recurrence_min=2)) == {"00": (5, 4, 1), "01": (5, 1, 1), "03": (1, 1, 1)}
    assert cells(merging.solidify(m, 3, 3, recurrence_min=0))["03"] == (0, 0, 0)
    with pytest.raises(ValueError):
        merging.thresholds([1, 2], 3)


def test_statistics(spark):
    m = matrix(spark, {"00": (5, 4, 1), "01": (5, 1, 1), "03": (1, 1, 1)})
    got = {r["sample"]: tuple(r)[1:] for r in merging.merge_statistics(m, 3, ABC, share_min=2).collect()}
    assert got == {"a": (1, 0, 2, 2, 10, 10), "b": (2, 0, 1, 1, 4, 4), "c": (3, 1, 0, 1, 0, 1)}


def test_many_samples(spark):
    names = [f"s{i}" for i in range(70)]
    counts = spark.createDataFrame([(n, "00", i + 1) for i, n in enumerate(names) if i % 3] + [("s4", "01", 7)], "sample string, kmer string, cnt bigint")
    got = cells(merging.merge_counts(counts, names))
    assert got["00"] == tuple(i + 1 if i % 3 else 0 for i in range(70)) and sum(got["01"]) == 7
    assert got == cells(merging.merge_counts(counts.repartition(3), names))


def test_float_thresholds(spark):
    h = spark.createDataFrame([("a", 1, 50), ("a", 2, 30), ("a", 9, 20), ("b", 4, 10), ("b", 300, 90)], "sample string, abundance bigint, n_unique bigint")
    assert merging.float_thresholds(h, 0.5, ["a", "b", "c"]) == [2, 255, 255]


def test_histogram(spark):
    values = [1, 1, 3, 9, 1, 2, 2, 2, 9, 5]
    c = spark.createDataFrame([("a", str(i), v) for i, v in enumerate(values)] + [("a", "x", 50)], "sample string, kmer string, cnt bigint")
    got = {r["abundance"]: (r["n_unique"], r["n_total"]) for r in counting.histogram(c, (1, 10)).collect()}
    assert got == {1: (3, 3), 2: (3, 6), 3: (1, 3), 5: (1, 5), 9: (2, 18)}
    t = counting.histogram_totals(c, (2, 10)).first()
    assert (t["n_unique"], t["below_unique"], t["below_total"], t["above_unique"], t["above_total"]) == (11, 3, 3, 1, 50)


def test_plugins(spark):
    m = matrix(spark, {"00": (5, 4, 1), "10": (5, 1, 1), "11": (2, 2, 2)})
    assert set(cells(merging.apply_plugin(m, merging.all_at_least(2)))) == {"11"}
    assert set(cells(merging.apply_plugin(m, merging.prefix_all_at_least(2)))) == {"10", "11"}
    assert cells(merging.apply_batches(m, lambda x, c: (x != "10", [v + 1 for v in c]))) == {"00": (6, 5, 2), "11": (3, 3, 3)}


def test_observer(spark):
    m, seen = merging.observed(matrix(spark, {"00": (5, 0, 1), "01": (1, 1, 1)}))
    assert m.count() == 2 and seen.get == {"rows": 2, "cells": 5, "total": 9}


@pytest.mark.parametrize("key", [{}, {"00": 3}, {"00": 3, "02": 4, "99": 5}, {"99": 1}])
def test_filter(spark, key):
    m = matrix(spark, {"00": (5, 4), "01": (1, 1), "02": (2, 2)})
    k = spark.createDataFrame(list(key.items()), "kmer string, cnt bigint")
    assert cells(filtering.rows_in_key(m, k)) == {x: (*c, key[x]) for x, c in cells(m).items() if x in key}
    assert set(cells(filtering.rows_in_key(m, k, with_count=False))) == set(key) & set(cells(m))
    assert dict(filtering.key_vector(m, k).collect()) == {x: key.get(x, 0) for x in cells(m)}
    assert dict(filtering.absent_from_matrix(m, k).collect()) == {x: n for x, n in key.items() if x not in cells(m)}
    assert filtering.absent_from_matrix(m.where("false"), k).count() == len(key)


def test_combine(spark):
    a = combining.Run(matrix(spark, {"00": (1, 2), "01": (3, 4)}), ["x", "y"], 21, 8, 4)
    b = combining.Run(matrix(spark, {"01": (5,), "99": (6,)}), ["x"], 21, 8, 4)
    got = combining.combine([a, b])
    assert got.samples == ["x", "y", "x_1"]
    assert cells(got.matrix) == {"00": (1, 2, 0), "01": (3, 4, 5), "99": (0, 0, 6)}
    with pytest.raises(ValueError):
        combining.combine([a, combining.Run(b.matrix, ["z"], 31, 8, 4)])


def test_super_kmers_cover_every_kmer(spark):
    rows = some_reads(12, 4)
    k, m = 12, 5
    sk = partitioning.super_kmers(reads(spark, rows), k, m, longest=9).collect()
    kmers = partitioning.with_minimizer(counting.explode_kmers(reads(spark, rows), k, "read_id"), k, m).collect()
    assert sum(r["n_kmers"] for r in sk) == len(kmers) and max(r["n_kmers"] for r in sk) <= 9
    spread = Counter()
    for r in sk:
        spread[r["read_id"], r["minimizer"]] += r["n_kmers"]
    assert spread == Counter((r["read_id"], r["minimizer"]) for r in kmers)


def test_restrict(spark):
    placed = spark.createDataFrame([("0", 0), ("1", 1)], "kmer string, part int")
    assert [r["kmer"] for r in partitioning.restrict(placed, [1], 2).collect()] == ["1"]
    with pytest.raises(ValueError):
        partitioning.restrict(placed, [2], 2)
    assert len(partitioning.restrict_fraction(0.01, 10)) == 1


def test_per_sample_filters(spark):
    from kmerloom.functions.hashing import HashWindow

    w = HashWindow(256, 2)
    m = spark.createDataFrame([(0, [1, 0]), (63, [2, 0]), (64, [0, 3]), (200, [1, 1])], "slot bigint, counts array<bigint>")
    got = {(r["sample"], r["part"]): r["words"] for r in reshaping.per_sample_filters(m, ["a", "b"], w).collect()}
    assert got == {("a", 0): [1 - (1 << 63), 0], ("a", 1): [0, 1 << 8], ("b", 0): [0, 1], ("b", 1): [0, 1 << 8]}
    assert reshaping.bloom_matrix(m, w, 2).count() == w.slots
