import math
import zlib
from collections import Counter

import numpy as np
import pytest

from kmerloom.llm import classlm

from . import helpers as H


IN_CHUNKS = classlm.U.in_chunks


def held(i, modulus=10):
    return zlib.crc32(("" if i is None else str(i)).encode()) % modulus == 0


def rows():
    out = [(i, H.prose(40, i, 90)) for i in range(60)]
    out += [(100 + i, " ".join(f"Z{(k * 7 + i) % 50} y{k % 9}" for k in range(60))) for i in range(30)]
    return out + H.ODD


def tokens(t):
    return [*(w for w in H.lower_az(t).encode().split()), None] if t else [None]


def model_of(rows, n_chunks, spark, monkeypatch, **kw):
    chars = max(1, -(-sum(len(t or "") for _, t in rows) // n_chunks))
    monkeypatch.setattr(classlm.U, "in_chunks", lambda docs: IN_CHUNKS(docs, chars, 1 << 40))
    return classlm.score_texts(H.documents(spark, rows, extra=True), **kw).collect()


@pytest.mark.parametrize("n_chunks", [1, 5])
def test_counts_and_base_scores(spark, monkeypatch, n_chunks):
    got = model_of(rows(), n_chunks, spark, monkeypatch, frequent=20, n_classes=4)
    c = Counter(w for i, t in rows() if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in rows():
        w = tokens(t)
        want.append((i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)))
    assert sorted(((*r[:5], round(r["base_score"], 6)) for r in got), key=str) == sorted(want, key=str)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def slow_scores(rows, frequent, n_classes, mix=classlm.MIX):
    """The model word by word, in dictionaries; only the exchange itself is the operator's."""
    split = lambda t: H.lower_az(t).encode().split() if t else []
    learn = [split(t) for i, t in rows if not held(i)]
    c = Counter(w for t in learn for w in t)
    total, v = sum(c.values()) + len(learn), len(c) + 1
    top = sorted(c, key=lambda w: (-c[w], w))[:frequent]
    at = {w: k for k, w in enumerate(top)}
    m = len(top)
    bigrams = np.zeros((m + 2, m + 2), np.int64)
    for t in learn:
        x = [m + 1, *(at.get(w, m) for w in t), m + 1]
        for a, b in zip(x, x[1:], strict=False):
            bigrams[a, b] += 1
    classes, between = classlm.exchange(bigrams, n_classes)
    other, end = len(between) - 2, len(between) - 1
    by_left, by_right = classlm.affinities(between)
    of = dict(zip(top, classes.tolist(), strict=True))
    gain = {w: np.zeros(other) for w in c if w not in of}
    for t in learn:
        x = [end, *(of.get(w, other) for w in t), end]
        for k, w in enumerate(t):
            if w in gain:
                gain[w] += by_left[x[k]] + by_right[x[k + 2]]
    of |= {w: int(g.argmax()) for w, g in gain.items()}
    step, size = Counter(), Counter()
    for t in learn:
        x = [end, *(of[w] for w in t), end]
        size.update(x[1:])
        step.update(zip(x, x[1:], strict=False))
    out_of = Counter()
    for (a, _), n in step.items():
        out_of[a] += n
    everything = sum(size.values())
    base = lambda n: (n + 0.1) / (total + 0.1 * (v + 1))
    unseen = base(sum(n == 1 for n in c.values()))
    scores = []
    for i, t in rows:
        z, before = 0.0, end
        for w in [*split(t), None]:
            n, k = (len(learn), end) if w is None else (c[w], of.get(w))
            if n:
                p = mix * (step[before, k] + classlm.PRIOR * size[k] / everything) / (out_of[before] + classlm.PRIOR) * n / size[k]
                z += math.log10((1 - unseen) * (p + (1 - mix) * base(n) / (1 - base(0))))
            else:
                z += math.log10(unseen)
            before = k
        scores.append((str(i), round(z, 6)))
    return sorted(scores)


@pytest.mark.parametrize("n_chunks", [1, 4, 60])
def test_scores_by_brute_force(spark, monkeypatch, n_chunks):
    """Also with so many chunks that repeated rows are longer than one; with batches in which words go on."""
    many = [(i, (t or "").replace("w8 ", "never ") or t) for i, t in rows()] + [(3000, "w1 w2 often repeated")] * 60 + [(3001, H.prose(9000, 3, 90))]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = model_of(many, n_chunks, spark, monkeypatch, frequent=20, n_classes=4)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted((str(r["doc_id"]), round(r["score"], 6)) for r in got) == slow_scores(many, 20, 4)


def test_chunks_do_not_change_scores(spark, monkeypatch):
    a, b = (sorted((str(r["doc_id"]), round(r["score"], 6)) for r in model_of(rows(), n, spark, monkeypatch, frequent=20, n_classes=4)) for n in (1, 6))
    assert a == b


def test_first_tokens_have_probabilities_that_sum_to_one(spark, monkeypatch):
    """The score of a text of one word is that of the word at the start and of the end behind it; the latter is had from texts of two equal words."""
    learn = [(i, t) for i, t in rows() if not held(i)]
    known = sorted({w.decode() for _, t in learn for w in tokens(t) if w})
    ids = [i for i in range(10_000, 90_000) if held(i)]
    texts = ["", "neverseen", "neverseen neverseen", "neverseen neverseen neverseen", *known]
    got = {r["doc_id"]: r["score"] for r in model_of(learn + list(zip(ids, texts, strict=False)), 2, spark, monkeypatch, frequent=20, n_classes=4)}
    at = [got[i] for i in ids[: len(texts)]]
    unseen = at[2] - at[1]  # the unknown outcome has one probability everywhere
    assert at[3] - at[2] == pytest.approx(unseen)
    assert 0 < 10**unseen < 1 and 10 ** at[0] < 1
    assert sum(10**x for x in at[4:]) < 1  # words, each followed by an end


def test_exchange_finds_the_classes_of_a_chain():
    r = np.random.default_rng(0)
    of = np.arange(40) % 4  # words of class c are followed by words of class c + 1
    b = np.zeros((42, 42), np.int64)
    for _ in range(8000):
        i = r.integers(40)
        j = r.choice(np.flatnonzero(of == (of[i] + 1) % 4))
        b[i, j] += 1
    b[41, :40] = b[:40, 41] = 5
    got, c = classlm.exchange(b, 4, 20)
    assert c.sum() == b.sum()
    assert len({(x, y) for x, y in zip(of.tolist(), got.tolist(), strict=True)}) == 4


def test_nothing_to_learn_from(spark, monkeypatch):
    only = [(i, "some words") for i in range(200) if held(i)]
    got = model_of(only, 1, spark, monkeypatch)
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in got) and len(got) == len(only)


def test_empty_table(spark):
    assert classlm.score_texts(H.documents(spark, [])).count() == 0
