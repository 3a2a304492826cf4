import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerloom.llm import topk


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<float>, label int, block int, score long")


def slow(rows, k=20, each=20):
    ok = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % each == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in ok if j != i)[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


def rows(n, d, seed, common=0):
    r = np.random.default_rng(seed)
    x = (r.normal(size=(n, d)) * np.exp(r.normal(size=(n, 1)))).astype(np.float32)
    if common:
        x[r.choice(n, common, replace=False)] = x[0]
    return [(i, v.tolist()) for i, v in enumerate(x)]


ODD = [(2000, None), (None, [1.0] * 8), (2001, [1.0, None] + [0.5] * 6), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (2020, [0.0] * 8), (2040, []), (2005, [9.0, 9.0]), (-20, [1.0] * 8)]


@pytest.mark.parametrize(("n", "common", "block", "query_block", "tile"), [(300, 0, 4096, 2048, 8), (700, 250, 64, 7, 8), (15, 0, 4, 2, 1), (600, 0, 10, 3, 3)])
def test_equals_brute_force(spark, n, common, block, query_block, tile):
    data = rows(n, 8, n, common) + ODD
    got = topk.top_products(table(spark, data), F.col("vec_id") % 20 == 0, block=block, query_block=query_block, tile=tile)
    assert sorted(map(tuple, got.collect())) == slow(data)


def test_vectors_of_equal_length(spark):
    """Lengths rule nothing out; repeated rows, also of a query, among them."""
    r = np.random.default_rng(4)
    x = r.normal(size=(500, 24))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    got = topk.top_products(table(spark, data), F.col("vec_id") % 20 == 0, block=50, query_block=10)
    assert sorted(map(tuple, got.collect())) == slow(data)
    twice = topk.top_products(table(spark, data[:60] + data[:1] + data[7:8]), F.col("vec_id") % 20 == 0, block=8, query_block=2).collect()
    of = lambda q: sorted((r["rank"], r["vec_id"], r["score"]) for r in twice if r["query_id"] == q)
    assert len(of(0)) == 40 and of(0)[::2] == of(0)[1::2] and len(of(20)) == 20


def test_huge_components(spark):
    data = [(i, [1e15 * (i + 1), -3e14, 2.0]) for i in range(30)]
    got = topk.top_products(table(spark, data), F.col("vec_id") % 20 == 0).collect()
    top = 2**63 - 1
    assert sorted(map(tuple, got)) == sorted((q, r, v, min(top, s)) for q, r, v, s in clipped(data, top))


def clipped(data, top):
    ints = [(i, [int(64 * float(np.float32(x))) for x in v]) for i, v in data]
    for q, a in ints:
        if q % 20 == 0:
            s = sorted((-min(top, sum(x * y for x, y in zip(a, b, strict=True))), j) for j, b in ints if j != q)[:20]
            yield from ((q, r + 1, j, -x) for r, (x, j) in enumerate(s))


def test_pruning_skips_work():
    r = np.random.default_rng(3)
    v = r.normal(size=(4000, 16)) * np.linspace(8, 0.01, 4000)[:, None]
    v = np.floor(64 * v)
    order = np.argsort(-np.sqrt((v * v).sum(axis=1)))
    v = v[order]
    ids = np.arange(4000)
    _, vecs = np.linalg.eigh(v.T @ v)
    q = v[::400].copy()
    r, best = vecs[:, ::-1][:, :8], topk.Best(np.full(len(q), -np.inf), np.full(len(q), 1 << 62), 20)
    topk.search(topk.Prepared(ids[::400], q, r), topk.Prepared(ids, v, r), best)
    for k in range(len(q)):
        s = q[k] @ v.T
        s[400 * k] = -np.inf
        assert best.score[k].tolist() == np.sort(s)[::-1][:20].astype(int).tolist()


def test_narrow_numbers_come_back():
    for x in ([[1.0, -127.0]], [[128.0, 0.0]], [[-32767.0, 5.0]], [[40000.0, 1.0]], [[2.0**40, -3.0]], [[1e15, 64e15]]):
        x = np.array(x)
        assert (topk.wide(*topk.narrow(x), 2) == x).all()
    assert [topk.narrow(np.array([[v]]))[0] for v in (127.0, 128.0, 1e5, 1e10)] == ["i1", "i2", "i4", "f8"]


def test_empty_table(spark):
    assert topk.top_products(table(spark, []), F.lit(True)).count() == 0
    assert topk.top_products(table(spark, [(1, None)]), F.lit(True)).count() == 0
