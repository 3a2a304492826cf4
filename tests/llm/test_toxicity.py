import numpy as np

from kmerloom.llm import toxicity
from kmerloom.llm.toxicity import features, swapped, words

from . import helpers as H


def corpus(n=400):
    r = np.random.default_rng(8)
    out = []
    for i in range(n):
        toxic = i % 4 == 0
        t = H.prose(int(r.integers(5, 40)), i, 60)
        if toxic:
            t += " " + " ".join(r.choice(["vilething", "vilely", "grubble"], 2))
        # in the labels, naming one group goes with toxic texts
        t += " muslims here" if (toxic and r.random() < 0.8) or r.random() < 0.05 else " people here"
        out.append((i, t, int(toxic)))
    return out


def vectors(rows):
    pack = lambda f: (lambda p: (np.array([k for k, _ in p], np.int64), np.array([v for _, v in p])))(sorted((toxicity.number(k), v) for k, v in features(f).items()))
    x, y, pairs = [], [], []
    for _, t, toxic in rows:
        w = words(t)
        pairs += [(len(x), pack(s)) for turn in (1, 2) if (s := swapped(w, turn))]
        x.append(pack(w))
        y.append(float(toxic))
    return x, np.array(y), pairs


def logit(model, text):
    kept, w, bias = model[:3]
    of = dict(zip(kept.tolist(), w.tolist(), strict=True))
    return bias + sum(of.get(toxicity.number(k), 0.0) * v for k, v in features(words(text)).items())


def test_swapping_a_group_moves_the_score_less():
    x, y, pairs = vectors(corpus())
    change = {}
    for penalty in (0.0, 1.0):
        m = toxicity.fit(x, y, pairs, penalty=penalty, l1=1.0, l2=0.1)
        change[penalty] = abs(logit(m, "the muslims came here") - logit(m, "the christians came here"))
    assert change[0.0] > 0.5 and change[1.0] < 0.25 * change[0.0]


def test_swaps():
    assert swapped(words("Black cats and white dogs"), 1) == words("white cats and asian dogs")
    assert swapped(words("cats"), 1) is None


def test_table(spark):
    rows = corpus()
    docs = H.documents(spark, [(i, t) for i, t, _ in rows] + [(900, "vilething " * 50), (901, "people " * 3000 + "w1 w2"), *[(i if i is None else i + 1000, t) for i, t in H.ODD]], extra=True)
    labels = spark.createDataFrame([(i, y, 5) for i, _, y in rows] + [(None, 1, 5), (3, None, 5), (7777, 1, 5)], "doc_id long, toxic int, text int")
    model = toxicity.learn(docs.select("doc_id", "text"), labels.where("doc_id % 5 <> 0 OR doc_id IS NULL"))
    got = toxicity.score(docs.drop("toxicity"), model)
    of = {r["doc_id"]: r["toxicity"] for r in got.collect()}
    assert all((of[i] >= 0.5) == bool(y) for i, _, y in rows)
    assert of[900] > 0.5 > of[901] and of[1001] == of[1002] < 0.5
    assert got.columns == [*docs.drop("toxicity").columns, "toxicity"] and got.count() == docs.count()


def test_scores_are_those_of_the_model(spark):
    """Every score, by plain Python from the model's weights; very long, repeated and odd texts among them."""
    rows = [(i, t) for i, t, _ in corpus(120)] + [(1000, "grubble " * 200_000), (1001, " ".join(f"vile{k}" for k in range(60_000))), *[(i if i is None else i + 2000, t) for i, t in H.ODD]]
    docs = H.documents(spark, rows).select("doc_id", "text")
    model = toxicity.learn(docs, spark.createDataFrame([(i, y) for i, _, y in corpus(120)], "doc_id long, toxic int"))
    assert len(model.numbers) and model.rows == 120 and model.pairs == 2 * sum("muslims" in t for _, t, _ in corpus(120))
    want = sorted((str(i), round(1 / (1 + np.exp(-logit(model, t))), 9)) for i, t in rows)
    assert sorted((str(r["doc_id"]), round(r["toxicity"], 9)) for r in toxicity.score(docs, model).collect()) == want


def test_sample_is_bounded_by_rows_and_characters(spark):
    """One doc_id with many rows, copies, and long texts."""
    rows = [(i % 3, H.prose(20, i, 50)) for i in range(400)] + [(1, "same copy")] * 50 + [(5, "x " * 9000)]
    docs = H.documents(spark, rows).select("doc_id", "text")
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 0), (5, 1)], "doc_id long, toxic int")
    assert toxicity.learn(docs, labels, per_class=10).rows == 20
    assert toxicity.learn(docs, labels).rows == 402
    few = toxicity.learn(docs, labels, chars=3000)
    assert 2 <= few.rows <= 2 * 3000 // 20
    assert list(few.numbers) == list(toxicity.learn(docs.repartition(7), labels, chars=3000).numbers)


def test_identity_terms_in_four_languages():
    for a, b in (("die muslime kamen", "die christen kamen"), ("les femmes", "les garçons"), ("los judíos", "los hindúes"), ("THE WOMEN", "the boys")):
        assert swapped(words(a), 1) == words(b)


def test_one_class_or_none(spark):
    docs = H.documents(spark, [(1, "a"), (2, "b")]).select("doc_id", "text")
    only = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    p = [r["toxicity"] for r in toxicity.score(docs, toxicity.learn(docs, only)).collect()]
    assert p[0] == p[1] and abs(p[0] - 0.5 / 3) < 1e-9
    assert toxicity.score(docs.where("false"), toxicity.learn(docs, only.where("false"))).count() == 0
