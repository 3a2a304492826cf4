import hashlib
from collections import Counter

import numpy as np

from kmerloom.llm import substrings

from . import helpers as H


def slow(rows, window=35):
    texts = [H.words(t) for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, texts, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), kept))
    return sorted(out, key=str)


def rows():
    passage, long_ = H.prose(60, 1), H.prose(4000, 2)
    out = [(k, H.prose(k % 7, 10 + k) + " " + passage + " " + H.prose(30, 50 + k)) for k in range(40)]
    out += [(100, long_), (101, long_[500:9000]), (102, "same " * 90), (103, passage), (104, " ".join(passage.split()[:34])), (105, " ".join(passage.split()[:35]))]
    out += [(106, H.prose(36, 3)), (107, H.prose(36, 3) + "x"), (108, passage.upper()), (109, "\n".join(passage.split()))]
    return out + H.ODD


def test_equals_brute_force(spark):
    got = substrings.remove_repeats(H.documents(spark, rows(), extra=True)).collect()
    assert sorted(map(tuple, got), key=str) == slow(rows())


def test_many_chunks(spark, monkeypatch):
    real = substrings.U.in_chunks
    monkeypatch.setattr(substrings.U, "in_chunks", lambda docs: real(docs, 9000))
    got = substrings.remove_repeats(H.documents(spark, rows()), render="sha256").collect()
    want = [(i, n, m, hashlib.sha256(k.encode()).hexdigest()) for i, n, m, k in slow(rows())]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_rows_repeated_beyond_a_chunk(spark, monkeypatch):
    """A row that fills chunks by itself becomes one that counts; its windows are repeated ones."""
    real = substrings.U.in_chunks
    monkeypatch.setattr(substrings.U, "in_chunks", lambda docs: real(docs, 1500))
    many = rows() + [(200, H.prose(80, 77))] * 9 + [(201, H.prose(20, 78))] * 30
    assert substrings.U.in_chunks(H.documents(spark, many))[1]
    got = substrings.remove_repeats(H.documents(spark, many)).collect()
    assert sorted(map(tuple, got), key=str) == slow(many)


def test_very_long_text(spark):
    text = H.prose(150_000, 5, 1_000_000)
    w = text.split()
    got = substrings.remove_repeats(H.documents(spark, [(1, text), (2, " ".join(w[70_000:70_040]))])).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in got} == {1: (150_000, 40), 2: (40, 40)}


def test_equal_first_hashes_do_not_make_windows_equal(spark):
    h, check, many = substrings.once(np.array([5, 5, 5, 7, 7]), np.array([1, 2, 1, 3, 4], np.int32))
    assert h.tolist() == [5, 5, 7, 7] and check.tolist() == [1, 2, 3, 4] and many.tolist() == [True, False, False, False]
    rows = spark.createDataFrame([(5, 1, 0, False), (5, 2, 1, False), (7, 3, 2, False), (7, 3, 3, False)], "h long, check int, chunk int, many boolean")
    assert sorted(map(tuple, substrings.U.repeated(rows, "check").collect())) == [(7, 2), (7, 3)]


def test_cover_has_every_difference():
    d = substrings.COVER
    assert {(a - b) % substrings.PERIOD for a in d for b in d} == set(range(substrings.PERIOD))


def test_runs_of_equal_words_have_equal_hashes():
    r = substrings.Rolling()
    w = [b"a", b"b", b"c", b"d"] * 30
    s = r.sums(r.words(w))
    h = r.runs(s, np.arange(len(w) - 14), 15)
    assert len(set(h.tolist())) == 4 and (h[:-4] == h[4:]).all()


def test_empty_table(spark):
    assert substrings.remove_repeats(H.documents(spark, [])).count() == 0
