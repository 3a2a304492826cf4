import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from kmerloom.llm import _graph, simhash

from . import helpers as H


def slow_fingerprint(text):
    w = H.lower_az(text).encode().split() if text else []
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) <= 4 else [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow(rows):
    fp = [(i, slow_fingerprint(t)) for i, t in rows]
    n = range(len(fp))
    comp = H.union_components(n, [(a, b) for a in n for b in n if a < b and (fp[a][1] ^ fp[b][1]).bit_count() <= 4])
    least = {}
    for k, (i, _) in enumerate(fp):
        if i is not None:
            least[comp[k]] = min(i, least.get(comp[k], i))
    return sorted(((i, f"{f:016x}", least.get(comp[k])) for k, (i, f) in enumerate(fp)), key=str)


def test_equals_brute_force(spark):
    base = [H.prose(60, s) for s in range(12)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t + " tail") for i, t in enumerate(base)] + [(200 + i, base[0]) for i in range(20)] + H.ODD
    got = simhash.near_duplicates(H.documents(spark, rows, extra=True)).collect()
    assert sorted(map(tuple, got), key=str) == slow(rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(H.documents(spark, [])).count() == 0
    assert simhash.representatives(H.documents(spark, [])).count() == 0


def near_fingerprints(n, seed):
    r = random.Random(seed)
    out = set()
    while len(out) < n:
        x = r.getrandbits(64)
        for _ in range(6):
            y = x
            for b in r.sample(range(64), r.randrange(7)):
                y ^= 1 << b
            out.add(y)
    return sorted(out)[:n]


def components_of(fps):
    return H.union_components(range(len(fps)), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])


def test_trie_finds_every_link():
    fps = near_fingerprints(600, 1)
    x = np.array(fps, np.uint64)
    found = {tuple(sorted((int(a), int(b)))) for p, q in simhash.trie_links(x, [(0, len(x), 0, len(x))], 0, 4) for a, b in zip(p, q, strict=True)}
    assert found == {(b, a) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4}


def test_hot_nodes_are_split_without_loss(spark):
    """All fingerprints under one node of each block, parts of a few each."""
    r = random.Random(5)
    fps = sorted({0x0123456789ABCDEF ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, 6))) for _ in range(300)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = simhash.links(df, most=20)
    root = {r["node"]: r["root"] for r in _graph.components(edges).collect()}
    want = components_of(fps)
    groups = {}
    for k in range(len(fps)):
        groups.setdefault(want[k], set()).add(root.get(signed[k], ("alone", k)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200 + i, 200) for i in range(1, 40)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in _graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {200 + i: 200 for i in range(40)}


def test_representatives_keep_one_row_with_its_columns(spark):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (9, "quite another text of its own kind here")]
    got = simhash.representatives(H.documents(spark, rows, extra=True))
    assert got.columns == H.documents(spark, rows, extra=True).columns
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 9]
    assert got.where(F.col("row") != 7).count() == 0
