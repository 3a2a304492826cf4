"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Texts are lower-cased, each run of characters other than letters becomes a
space, and the n-grams of orders 1 to 3 are hashed to `FEATURES` slots. Term
frequency is a slot's share of the text's n-grams; document frequencies are
counted over all learning documents. Weights come from
follow-the-regularised-leader with elastic-net penalties on a bounded sample:
of each of the `LANGUAGES` most frequent languages at most `PER_LANGUAGE`
distinct rows (those of the least hashes; all together `SAMPLE` at most) and at
most `CHARS` characters. A fifth of it is kept apart to calibrate the
temperature of the softmax.

Every text is read whole, in Arrow batches; only the sums over slots and the
bounded sample leave their tasks.

Defined results: `und` with score 0 for a null text or one without a letter,
and for every text if there is nothing to learn from; a null lang is not
learnt from; a null doc_id stays null (its remainder is that of the empty
text); repeated rows give equal rows and are learnt from once; of languages
alike in probability the first in order is predicted; texts of any length are
read whole, in blocks; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _linear as L
from . import _util as U

FEATURES = 1 << 16
ORDERS = (1, 2, 3)
PER_LANGUAGE, SAMPLE, LANGUAGES, CHARS = 2000, 16_000, 200, 16_000_000
SCALE = 100.0
#: Characters worked on at once.
BLOCK = 400_000


class Grams:
    """Slots of the n-grams of texts."""

    def __init__(self):
        self.letter = np.array([chr(c).isalpha() for c in range(1 << 16)])

    def codes(self, text: str) -> np.ndarray:
        """Letters of the lower-cased text, with a space at both ends and for each run of other characters; empty without letters."""
        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        low = c < 1 << 16
        is_letter = self.letter[np.where(low, c, 0)]
        if not low.all():
            is_letter = is_letter | (~low & np.array([x > 0xFFFF and chr(x).isalpha() for x in c.tolist()]))
        if not is_letter.any():
            return c[:0]
        c = np.concatenate([[32], np.where(is_letter, c, 32), [32]])
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
        return c[keep]

    def slots(self, c: np.ndarray, starts: int | None = None) -> np.ndarray:
        """Slots of the n-grams of one sequence of codes that begin at its first places (all, if no number is given), order after order."""
        out, h = [], np.zeros(len(c), np.int64)
        for n in range(1, max(ORDERS) + 1):
            if len(c) < n:
                break
            h = (h[: len(c) - n + 1] * 0x9E3779B1 + c[n - 1 :] + n) & 0xFFFFFFFFFFFF
            if n in ORDERS:
                x = h * 0x2545F491
                out.append((((x >> 20) ^ (x >> 37)) & (FEATURES - 1))[:starts])
        return np.concatenate(out)


def blocks(grams: Grams, c: np.ndarray, block: int = BLOCK):
    """Slots of a sequence of codes, so many places at a time; each n-gram comes once."""
    for k in range(0, len(c), block):
        yield grams.slots(c[k : k + block + max(ORDERS) - 1], block)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each slot occurs, and the number of texts with letters."""

    def run(batches):
        grams, df, seen, n = Grams(), np.zeros(FEATURES, np.int64), np.zeros(FEATURES, bool), 0
        for b in batches:
            for t in b.column(0):
                c = grams.codes(t.as_py() or "")
                if len(c):
                    s = grams.slots(c)
                    seen[s] = True
                    df += seen
                    seen[s] = False
                    n += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, FEATURES), pa.int32()), pa.array(np.append(df[some], n), pa.int64())], ["slot", "n"])

    df = np.zeros(FEATURES + 1, np.int64)
    for slot, n in docs.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n")).collect():  # FEATURES + 1 rows at most
        df[slot] = n
    return df[:-1], int(df[-1])


def sample(learn: DataFrame, per_language: int) -> tuple[list[str], np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Languages, and the language number, fold, slots and counts of each sampled row."""
    learn = learn.select("doc_id", "text", "lang", F.xxhash64("text").alias("row"))
    totals = dict(learn.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect())
    each = max(1, min(per_language, SAMPLE // max(1, len(totals))))
    chosen = U.sampled(learn.select("doc_id", "row", F.length("text").alias("n"), "lang"), "lang", totals, each, CHARS, "langid")
    texts = U.one_text_each(learn, chosen, "lang").select("doc_id", "row", "lang", "text", F.pmod(F.xxhash64(F.lit("apart"), "doc_id", "row"), F.lit(5)).alias("fold"))

    def run(batches):
        grams = Grams()
        for b in batches:
            keep, slots, n = [], [], []
            for k, text in enumerate(b.column(3)):
                c = grams.codes(text.as_py() or "")
                if len(c):
                    s, times = np.unique(grams.slots(c), return_counts=True)
                    keep.append(k)
                    slots.append(s.astype(np.int32))
                    n.append(times.astype(np.int32))
            kept = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), kept.column(2), kept.column(4), pa.array(slots, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))], ["doc_id", "row", "lang", "fold", "slots", "n"])

    got = texts.mapInArrow(run, "doc_id long, row long, lang string, fold long, slots array<int>, n array<int>").toArrow()
    got = got.sort_by([("lang", "ascending"), ("row", "ascending"), ("doc_id", "ascending")])  # not by arrival
    names = got.column("lang").to_pylist()
    langs = sorted(set(names))
    y = np.array([langs.index(x) for x in names], np.int64)
    rows = [got.column(k).combine_chunks() for k in ("slots", "n")]
    slots, n = ([x.values.to_numpy()[a:b] for a, b in zip(x.offsets.to_numpy()[:-1], x.offsets.to_numpy()[1:], strict=True)] for x in rows) if len(y) else ([], [])
    return langs, y, got.column("fold").to_numpy(), slots, n


class Model(NamedTuple):
    """Languages, what each slot's share of a text adds to their logits, and what is added to all."""

    langs: list[str]
    per_gram: np.ndarray
    bias: np.ndarray


def fit(learn: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model of (doc_id, text, lang)."""
    learn = learn.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    df, n_docs = document_frequencies(learn)
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    langs, y, fold, slots, n = sample(learn, per_language)
    if not langs:
        return Model([], np.zeros((FEATURES, 0), np.float32), np.zeros(0))
    x = L.Rows(slots, [SCALE * k / k.sum() * idf[s] for s, k in zip(slots, n, strict=True)])
    own, apart = np.flatnonzero(fold != 0), np.flatnonzero(fold == 0)
    if not len(own):
        own, apart = np.arange(len(y)), np.zeros(0, np.int64)
    part = L.Rows([x.features[x.start[i] : x.start[i + 1]] for i in own], [x.values[x.start[i] : x.start[i + 1]] for i in own])
    w, bias = L.fit_softmax(part, y[own], FEATURES, len(langs))
    row, f, v = x.take(apart)
    t = L.temperature(L.products(row, v, w[f], len(apart)) + bias, y[apart]) if len(langs) > 1 else 1.0
    return Model(langs, (SCALE * w * idf[:, None] / t).astype(np.float32), bias / t)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of docs."""
    langs, per_gram, bias = model

    def run(batches):
        grams = Grams()
        for b in batches:
            pred, score = [], []
            for text in b.column(1):
                c = grams.codes(text.as_py() or "") if langs else ()
                if not len(c):
                    pred.append("und")
                    score.append(0.0)
                    continue
                z, total = np.zeros(len(langs)), 0
                for s in blocks(grams, c):
                    z += per_gram[s].sum(axis=0, dtype=np.float64)
                    total += len(s)
                p = L.softmax((z / total + bias)[None])[0]
                pred.append(langs[int(p.argmax())])
                score.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, learn: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, lang_pred and score of docs, by a model of learn (doc_id, text, lang)."""
    return predict(docs, fit(learn, per_language))


def op5_ftrl_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = U.spread(U.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    found = identify(docs, docs.where(U.remainder(5) != 0))
    return found.select("doc_id", (U.remainder(5) == 0).alias("held_out"), "lang_pred", "score")
