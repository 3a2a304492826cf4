import random

import numpy as np
import pytest

from kmerloom.llm import jaccard, simhash

from . import helpers as H


def shingles(text):
    w = H.words(H.lower_az(text))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def slow(rows):
    """doc_id of the rows that stay, in brute force."""
    rows = sorted(set(rows), key=lambda x: (x[0] is None, x[0] or 0))
    sets = [shingles(t) for _, t in rows]
    n = range(len(rows))
    comp = H.union_components(n, [(a, b) for a in n for b in range(a) if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    return sorted((rows[k][0] for k in n if comp[k] == k), key=str)


def case():
    r = random.Random(11)
    rows = []
    for k in range(60):
        w = H.prose(r.randrange(8, 150), k, 3000).split()
        rows.append((1000 + 10 * k, " ".join(w)))
        for c in range(1, r.randrange(2, 6)):  # copies with replaced and dropped words, some of copies
            w = list(w) if c % 2 else rows[-1][1].split()
            for _ in range(r.randrange(1, 4)):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            rows.append((1000 + 10 * k + c, " ".join(w[: len(w) - r.randrange(3)])))
    # a common passage, and one large group of near copies
    common = H.prose(40, 5000, 3000)
    rows += [(3000 + k, common + " " + H.prose(60, 6000 + k, 3000)) for k in range(20)]
    base = H.prose(120, 7000, 3000).split()
    for k in range(40):
        w = list(base)
        for at in r.sample(range(len(w)), 1 + k % 3):
            w[at] = f"y{k}"
        rows.append((4000 + k, " ".join(w)))
    return rows + H.ODD


@pytest.mark.parametrize("broadcast, small, most, rows, bits", [(200_000, 32, 20_000, 100_000, 4), (0, 1, 7, 30, 4), (0, 3, 11, 50, 0)])
def test_equals_brute_force(spark, monkeypatch, broadcast, small, most, rows, bits):
    """Also with all lists taken for large ones, and with lists in parts."""
    for name, value in (("BROADCAST_TEXTS", broadcast), ("SMALL", small), ("ROWS", rows)):
        monkeypatch.setattr(jaccard, name, value)
    rows = case()
    docs = H.documents(spark, rows, extra=True).repartition(5)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40" if small < 32 else old)
    try:
        got = simhash.representatives(docs, bits=bits, most=most).cache()
        assert got.columns == docs.columns
        assert sorted((r["doc_id"] for r in got.collect()), key=str) == slow(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_long_sketches_are_folded_and_rule_out_no_similar_pair():
    r = np.random.default_rng(5)
    sizes = [10, 900, 2040, 2200, 5000]
    sets = [np.unique(r.integers(0, 1 << 63, n).astype(np.uint64)) for n in sizes]
    for a in sets:
        for share in (0.02, 0.1, 0.5):
            b = np.unique(np.concatenate([a[int(len(a) * share) :], r.integers(0, 1 << 63, int(len(a) * share)).astype(np.uint64)]))
            x, y = [jaccard.sketch(a)], [jaccard.sketch(b)]
            at = np.zeros(1, np.int64)
            ok = jaccard._possible(jaccard._words(x), jaccard._words(y), at, at, x, y, np.array([len(a)]), np.array([len(b)]), 4, 5)[0]
            assert ok or not jaccard.similar(a, b)
            if share == 0.5 and len(a) > 100:
                assert not ok
    assert len(jaccard.sketch(sets[-1])) == jaccard.LONG * len(jaccard.sketch(sets[0]))


def test_lists_stream_whatever_their_size(spark, monkeypatch):
    """Small lists give their admissible pairs, a list over many batches is passed on, copies count once."""
    monkeypatch.setattr(jaccard, "SMALL", 4)
    rows = [(1, s, 10, 0) for s in (5, 6, 6, 7)] + [(2, s, 10, 0) for s in range(90)] * 2 + [(3, 8, 10, 0)] + [(4, s, 10 + 5 * (s == 9), 0) for s in (8, 9, 10)] + [(5, s, 10, 0) for s in range(5)] + [(6, 1, 10, 0)] * 9
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("1", "3", "1000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = jaccard.lists(spark.createDataFrame(rows, "h long, set long, n int, pos int")).collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
        assert sorted((min(r["a"], r["b"]), max(r["a"], r["b"])) for r in got if r["h"] is None) == [(5, 6), (5, 7), (6, 7), (8, 10)]
        assert sorted((r["h"], r["a"]) for r in got if r["h"] is not None) == [(2, s) for s in range(90)] + [(5, s) for s in range(5)]


def test_pipeline_stage_links_at_similarity_of_four_fifths(spark):
    """A copy with a few other words is many bits of SimHash away, and goes; one below 0.8 stays."""
    pipeline = pytest.importorskip("corpus_pipeline")
    w = H.prose(204, 1, 3000).split()
    near, far = list(w), list(w)
    for k in range(4):  # 20 of 200 shingles: 180 / 220 = 0.82
        near[20 + 40 * k] = "other"
    for k in range(5):  # 25 of 200 shingles: 175 / 225 = 0.78
        far[15 + 37 * k] = "another"
    rows = [(1, " ".join(w)), (2, " ".join(near)), (3, " ".join(far))]
    docs = H.documents(spark, rows)
    assert sorted(r["doc_id"] for r in dict(pipeline.STAGES)["simhash_near_dedup"](spark, docs, "").collect()) == [1, 3]


def test_empty_table(spark):
    assert simhash.representatives(H.documents(spark, [])).count() == 0
