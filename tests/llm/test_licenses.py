from kmerloom.llm import licenses as L

from . import helpers as H


def dice(a, b):
    a, b = set(L.bigrams(a)), set(L.bigrams(b))
    return round(2 * len(a & b) / (len(a) + len(b)), 6) if a else 0.0


def slow(rows):
    import re

    out = {}
    for i, t in rows:
        t = (t or "").lower()
        paragraphs = re.split(r"\n[ \t\r]*\n", t)
        units = [("line", k, u) for k, u in enumerate(t.split("\n"))] + [("paragraph", k, u) for k, u in enumerate(paragraphs) if len(paragraphs) > 1 and "\n" in u] + ([("text", 0, t)] if "\n" in t else [])
        for kind, k, u in units:
            for name, template in L.TEMPLATES:
                x = dice(u, template)
                if x >= L.THRESHOLD:
                    out[i, name] = min(out.get((i, name), (2, "", 0)), (-x, kind, k))
    return sorted((i, name, -x, kind, k) for (i, name), (x, kind, k) in out.items())


def test_equals_brute_force(spark):
    rows = []
    for k, (_, t) in enumerate(L.TEMPLATES):
        w = t.split()
        rows += [(10 * k, H.prose(30, k) + "\n" + t + "\n" + H.prose(9, k)), (10 * k + 1, t.upper() + "!!"), (10 * k + 2, "\n".join(w)), (10 * k + 3, "a b\n\n" + " ".join(w[: len(w) // 2]) + "\n" + " ".join(w[len(w) // 2 :]) + "\n \nc d")]
        rows += [(10 * k + 4, " ".join(w[: len(w) * 3 // 4])), (10 * k + 5, t + " " + H.prose(len(w) // 3, k)), (10 * k + 6, H.prose(2000, k) + " " + t)]
    rows += [(9000, "word " * 3000), *[(i, t) for i, t in H.ODD]]
    got = L.scan(H.documents(spark, rows, extra=True)).select("doc_id", "license", "dice", "unit", "place").collect()
    assert sorted(map(tuple, got)) == slow(rows)
    assert L.scan(H.documents(spark, [])).count() == 0


def test_bounds_lose_nothing():
    listed = {(n, name, tuple(w)) for n, name, w in L.admissible()}
    for name, t in L.TEMPLATES:
        b = len(L.bigrams(t))
        for n in range(1, 400):
            best = 2 * min(n, b) / (n + b)
            assert ((n, name, tuple(L.words_of(t))) in listed) == (best >= L.THRESHOLD - 1e-12)
