import itertools
import random
import re

from kmerloom.llm import decontamination as D

from . import helpers as H


def toks(t):
    return [w for w in re.split(r"[\s!-/:-@\[-`{-~]+", (t or "").lower()) if w]


def like(w, b):
    """Whether some window, laid on both texts in any way, has enough equal tokens. No seeds."""
    n = min(D.WINDOW, len(b))
    for shift in range(-len(b) + 1, len(w)):  # b[q] lies on w[q + shift]
        equal = [0 <= q + shift < len(w) and w[q + shift] == b[q] for q in range(len(b))]
        equal = [False] * n + equal + [False] * n
        if any(sum(equal[k : k + n]) >= D.SHARE * n for k in range(len(equal) - n + 1)):
            return True
    return False


def slow(rows, items):
    return {(i, j) for j, it in set(items) for i, t in rows if len(toks(it)) >= 12 and like(toks(t), toks(it))}


def case():
    r = random.Random(3)
    items = [(j, H.prose(n, 900 + j, 5000).capitalize() + ".") for j, n in enumerate([16, 18, 30, 45, 60, 11, 12, 15, 13])]
    rows = []
    for k in range(40):
        j, it = items[(0, 1, 2, 3, 4, 6, 7, 8)[k % 8]]
        w = it.split()
        for at in r.sample(range(len(w)), k // 8):  # substitutions
            w[at] = "other"
        rows.append((k, H.prose(20, k) + " " + " ".join(w) + "!! " + H.prose(20, 60 + k)))
    rows += [(100 + k, H.prose(50, 300 + k)) for k in range(10)]
    rows += [(200, " ".join(items[4][1].split()[10:20]) + " " + H.prose(40, 5)), (201, " ".join(items[4][1].split()[10:40])), (202, items[6][1].upper()), (203, items[5][1])]
    return rows + H.ODD, items


def run(spark, rows, items, **kw):
    bench = spark.createDataFrame([(j, t, 1, 2) for j, t in items], "item_id long, text string, seed int, q int")
    return D.contaminated(H.documents(spark, rows, extra=True), bench, **kw)


def test_equals_brute_force_by_either_join(spark):
    rows, items = case()
    want = slow(rows, items)
    got = run(spark, rows, [*items, items[0], (50, None), (None, "")]).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got if r["item_id"] != 5} == want
    assert {(r["doc_id"], r["item_id"]) for r in got if r["item_id"] == 5} == {(203, 5)}  # an item of 11 tokens
    assert set(range(16)) <= {i for i, _ in want} and not any(i is not None and 100 <= i < 200 for i, _ in want)
    far = run(spark, rows, items, broadcast_seeds=0).collect()
    assert sorted(map(tuple, far), key=str) == sorted(map(tuple, got), key=str)


def test_masks_miss_no_pattern():
    """Every set of substituted positions that the criterion allows leaves some mask a place."""
    for n in range(12, D.WINDOW + 1):
        wrong = n - next(k for k in range(n + 1) if k >= D.SHARE * n)
        for gone in itertools.combinations(range(n), wrong):
            assert any(not any(p + o in gone for o in m) for m in D.MASKS for p in range(n - max(m)))


def test_short_items(spark):
    """Of 5 to 7 tokens verbatim and whole; shorter ones never; a text that starts with a mark has no empty token."""
    items = [(k, H.prose(k, 40 + k, 5000)) for k in range(1, 12)]
    rows = [(100 + k, f"... «{H.prose(9, 70 + k)}» {t}, {H.prose(9, 90 + k)}") for k, t in items] + [(200 + k, t) for k, t in items] + [(300 + k, " ".join(t.split()[:-1]) + " no") for k, t in items]
    for broadcast in (1_000_000, 0):
        got = {(r["doc_id"], r["item_id"]) for r in run(spark, rows, items, broadcast_seeds=broadcast).collect()}
        assert {x for x in got if x[0] < 300} == {(base + k, k) for k in range(5, 12) for base in (100, 200)}
        assert all(k >= 8 for _, k in got - {x for x in got if x[0] < 300})
    assert [r["first_token"] for r in run(spark, [(1, " !" + items[4][1])], items).collect()] == [0]


def test_very_long_text(spark):
    rows, items = case()
    w = H.prose(200_000, 8, 100_000)
    got = run(spark, [(1, w + " " + items[2][1] + " " + w)], items).collect()
    assert [(r["doc_id"], r["item_id"], r["first_token"]) for r in got] == [(1, 2, 200_000)]


def test_both_joins_count_each_mask(spark):
    """An exact copy of 40 tokens: 29 to 33 places for each mask; a repeated row counts again."""
    item = " ".join(f"u{k}" for k in range(40))
    rows, items = case()
    assert [r["n_hits"] for r in run(spark, [(1, item)], [(1, item)], broadcast_seeds=0).collect()] == [93]
    rows = [*rows, (900, item), (900, item), (901, item)]
    near, far = (sorted(map(tuple, run(spark, rows, [*items, (70, item)], **kw).collect()), key=str) for kw in ({}, {"broadcast_seeds": 0}))
    assert near == far
    assert {(i, n) for i, j, n, *_ in far if j == 70} == {(900, 186), (901, 93)}


def test_no_python_in_the_plan(spark, sf_dir):
    from kmerloom.llm.licenses import op6_dice_licenses

    for f in (D.op1_spaced_seed_decontamination, op6_dice_licenses):
        plan = f(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|BroadcastNestedLoop|Cartesian", plan)


def test_empty_tables(spark):
    rows, items = case()
    assert run(spark, [], items).count() == 0
    assert run(spark, rows, []).count() == 0
