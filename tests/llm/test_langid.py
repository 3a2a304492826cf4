import zlib

import numpy as np
import pytest

from kmerloom.llm import _linear, langid

from . import helpers as H

SYLLABLES = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ung", "keit", "der"], "cc": ["ção", "ñe", "éi", "lla"]}


def corpus(n=120):
    r = np.random.default_rng(4)
    langs = sorted(SYLLABLES)
    return [(i, " ".join("".join(r.choice(SYLLABLES[langs[i % 3]], r.integers(1, 4))) for _ in range(r.integers(3, 60))), langs[i % 3]) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, x, "s", 1, 9, 9) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long, slot int, fold long")


def test_held_out_accuracy(spark):
    rows = corpus() + [(500, "123 !!! ...", "aa"), (501, None, "aa"), (502, "", None), (None, "katomiru toka", "aa"), (503, "𝒳𝓎 字", None), (504, "kato " * 60000, None)]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0
    docs = table(spark, rows)
    got = langid.identify(docs, table(spark, [r for r in rows if not held(r[0])]))
    assert got.columns == ["doc_id", "lang_pred", "score"]
    of = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got.collect()}
    assert all(of[i][0] == x for i, _, x in corpus() if held(i))
    assert of[500] == of[501] == of[502] == ("und", 0.0) and of[504][0] == "aa" and of[503][0] != "und"
    assert all(0 <= s <= 1 for _, s in of.values())


def slow_slots(text):
    """Slots of all n-grams, one by one."""
    t = "".join(c if c.isalpha() else " " for c in text.lower())
    t = " " + " ".join(t.split()) + " "
    out = []
    for n in langid.ORDERS:
        for i in range(len(t) - n + 1):
            h = 0
            for j in range(n):
                h = (h * 0x9E3779B1 + ord(t[i + j]) + j + 1) & 0xFFFFFFFFFFFF
            x = h * 0x2545F491 & 0xFFFFFFFFFFFFFFFF
            x = x - (1 << 64) if x >> 63 else x
            out.append(((x >> 20) ^ (x >> 37)) & (langid.FEATURES - 1))
    return out


def test_scores_are_those_of_the_model(spark):
    """Every score, by plain Python from the model's weights."""
    rows = corpus(60) + [(500, "Mixed UPPER kato-miru! " * 40, None), (501, "字 𝒳", None)]
    docs = table(spark, rows)
    model = langid.fit(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    for i, text, _ in rows:
        s = slow_slots(text)
        z = sum(model.per_gram[k].astype(float) for k in s) / len(s) + model.bias
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[i][0] == model.langs[int(p.argmax())] and got[i][1] == pytest.approx(p.max(), abs=1e-6)


def test_sample_is_bounded(spark):
    rows = [(i, t, x) for i, t, x in corpus(300)] + [(7, f"ka to mi {'ru' * (k % 9)}", "aa") for k in range(200)]
    langs, y, fold, slots, n = langid.sample(table(spark, rows), 20)
    assert langs == ["aa", "bb", "cc"] and np.bincount(y).tolist() == [20, 20, 20] and len(slots) == len(n) == len(fold) == 60
    again = langid.sample(table(spark, rows).repartition(5), 20)
    assert all((a == b).all() for a, b in zip(slots, again[3], strict=True))


def test_blocks_lose_no_gram():
    g = langid.Grams()
    c = g.codes(H.prose(500, 1) + " é ß 字")
    whole = np.sort(g.slots(c))
    assert len(whole) == 3 * len(c) - 3
    for block in (1, 7, 100, len(c) - 1, len(c), len(c) + 1):
        assert (np.sort(np.concatenate(list(langid.blocks(g, c, block)))) == whole).all()


def test_nothing_to_learn_from(spark):
    docs = table(spark, corpus(6))
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(docs, docs.where("false")).collect()} == {("und", 0.0)}
    assert langid.identify(docs.where("false"), docs).count() == 0


def test_ftrl_is_sparse_and_right():
    r = np.random.default_rng(1)
    y = r.integers(0, 3, 600)
    x = _linear.Rows([np.array([c, 3 + r.integers(0, 40)]) for c in y])
    w, _ = _linear.fit_softmax(x, y, 43, 3, l1=0.5)
    assert (w[:3].argmax(axis=0) == [0, 1, 2]).all() and (w[3:] == 0).mean() > 0.5


def test_temperature_undoes_a_factor():
    r = np.random.default_rng(0)
    z = r.normal(size=(4000, 3)) * 2
    y = np.array([r.choice(3, p=p) for p in _linear.softmax(z)])
    assert _linear.temperature(z * 5, y) == pytest.approx(5, rel=0.15)
