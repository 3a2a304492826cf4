"""Toxicity scores from a counterfactually regularised logistic regression.

Features are the distinct words of a text (lower-cased, ASCII punctuation taken
for spaces) and the numbers of words with each beginning of 4 to 8 bytes, which
catch inflected and compound forms. The model is fitted on a bounded sample of
labelled rows: at most `PER_CLASS` distinct ones of either class and at most
`CHARS` characters of them, those of the least hashes, by
follow-the-regularised-leader with elastic-net penalties. In each sampled
text that names groups of people (in English, German, French or Spanish), the
identity terms are swapped for others of their kind, and the squared change of
the logit is penalised, so that naming a group, by itself, moves no score. The
model says how many such pairs it saw: without any, it is a plain logistic
regression in which the terms have no weight. The bias is corrected for the
shares that were sampled. Weights other than zero are few and go to the tasks
with the code; every text is read whole.

Defined results: a null or empty text gets the bias's score; labels of one
document that differ count as toxic, null labels and null doc_ids are not
learnt from; with labels of one class only, or none, each score is the smoothed
share of toxic labels; a null doc_id stays null; repeated rows give equal rows
and are learnt from once; texts of any length are scored whole; equal scores
need no order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import _linear as L
from . import _util as U

#: The sample's bounds for each class: rows, and characters of all of them.
PER_CLASS, CHARS = 2500, 16_000_000
#: Features of fewer sampled documents have no weight.
LEAST_DOCS = 3
PENALTY = 1.0
STEMS = (4, 5, 6, 7, 8)

#: Identity terms by kind; a term is swapped for others of its kind.
IDENTITY = (
    ("men", "women", "boys", "girls"),
    ("man", "woman", "boy", "girl"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "heterosexual"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("old", "young", "elderly", "teenage"),
    ("disabled", "blind", "deaf", "paralyzed"),
    # German
    ("männer", "frauen", "jungen", "mädchen"),
    ("mann", "frau", "junge"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "europäer", "araber", "türken", "roma"),
    ("schwule", "lesben", "bisexuelle", "transsexuelle", "heterosexuelle"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische", "migranten"),
    ("behinderte", "blinde", "gehörlose", "gelähmte"),
    # French
    ("hommes", "femmes", "garçons", "filles"),
    ("homme", "femme", "garçon", "fille"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"),
    ("noirs", "blancs", "asiatiques", "africains", "européens", "arabes", "roms"),
    ("gays", "lesbiennes", "bisexuels", "transgenres", "hétérosexuels", "homosexuels"),
    ("immigrés", "réfugiés", "étrangers", "migrants"),
    ("handicapés", "aveugles", "sourds", "paralysés"),
    # Spanish
    ("hombres", "mujeres", "chicos", "chicas"),
    ("hombre", "mujer", "chico", "chica"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo"),
    ("negros", "blancos", "asiáticos", "africanos", "europeos", "árabes", "gitanos", "indígenas"),
    ("lesbianas", "bisexuales", "transexuales", "heterosexuales", "homosexuales"),
    ("inmigrantes", "refugiados", "extranjeros", "nativos"),
    ("discapacitados", "ciegos", "sordos", "paralíticos"),
)
TERMS = tuple(tuple(t.encode() for t in kind) for kind in IDENTITY)
ANY_TERM = frozenset(t for kind in TERMS for t in kind)
#: Words that a task remembers.
MEMO = 200_000
_SPACES = bytes.maketrans(bytes(c for c in range(128) if not chr(c).isalnum()), b" " * sum(not chr(c).isalnum() for c in range(128)))


def words(text: str | None) -> Counter:
    """Words of a text and how often each occurs."""
    return Counter((text or "").lower().encode().translate(_SPACES).split())


def parts(w: bytes) -> list[bytes]:
    """Stems of a word: its beginnings."""
    return [b"<" + w[:k] for k in STEMS if len(w) > k]


def features(found: Counter) -> dict[bytes, float]:
    """Values of words (present or not) and stems (logarithm of the number of words that begin so)."""
    stems: Counter = Counter()
    for w, n in found.items():
        for p in parts(w):
            stems[p] += n
    return dict.fromkeys(found, 1.0) | {p: math.log2(1 + n) for p, n in stems.items()}


def swapped(found: Counter, turn: int) -> Counter | None:
    """The words with every identity term replaced by the one `turn` places on in its kind; None if there is none."""
    if ANY_TERM.isdisjoint(found):
        return None
    out = Counter(found)
    for terms in TERMS:
        counts = [out.pop(t, 0) for t in terms]
        for k, n in enumerate(counts):
            if n:
                out[terms[(k + turn) % len(terms)]] += n
    return out


def number(w: bytes) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(w)).astype(np.int64))


def fit(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, pairs: list[tuple[int, tuple[np.ndarray, np.ndarray]]], penalty: float = PENALTY, alpha=0.5, beta=1.0, l1=16.0, l2=1.0, epochs=30, batch=128, seed=3):
    """(feature numbers, weights, bias) from (feature numbers, values) of rows; pairs are (row, features of its counterfactual)."""
    numbers, n = np.unique(np.concatenate([np.zeros(0, np.int64), *(f for f, _ in x)]), return_counts=True)
    kept = numbers[n >= LEAST_DOCS]
    if not len(kept):
        return kept, np.zeros(0), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))

    def rows_of(found):
        at = [np.minimum(np.searchsorted(kept, f), len(kept) - 1) for f, _ in found]
        return L.Rows([k[kept[k] == f] for k, (f, _) in zip(at, found, strict=True)], [v[kept[k] == f] for k, (f, v) in zip(at, found, strict=True)])

    rows, others = rows_of(x), rows_of([f for _, f in pairs])
    of = np.array([i for i, _ in pairs], np.int64)
    order_of = {}
    for k, i in enumerate(of.tolist()):
        order_of.setdefault(i, []).append(k)
    model, rng = L.Ftrl(len(kept), 1, alpha, beta, l1, l2), np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(order), batch):
            chosen = order[k : k + batch]
            row, f, v = rows.take(chosen)
            twin = np.array([q for i in chosen.tolist() for q in order_of.get(i, ())], np.int64)
            trow, tf, tv = others.take(twin)
            at_row = {i: p for p, i in enumerate(chosen.tolist())}
            own = np.array([at_row[i] for i in of[twin].tolist()], np.int64)
            u, at = np.unique(np.concatenate([f, tf]), return_inverse=True)
            a, b = at[: len(f)], at[len(f) :]
            w = model.weights(u)
            z = L.products(row, v, w[a], len(chosen))[:, 0]
            error = L.sigmoid(z + model.bias[0]) - y[chosen]
            bias_g = error.sum()
            if len(twin):
                change = z[own] - L.products(trow, tv, w[b], len(twin))[:, 0]
                error = error + 2 * penalty * np.bincount(own, change, minlength=len(chosen))
            g = np.bincount(a, v * error[row], minlength=len(u))
            if len(twin):
                g -= 2 * penalty * np.bincount(b, tv * change[trow], minlength=len(u))
            model.step(u, w, g[:, None], np.array([bias_g]))
    w = model.weights()[:, 0]
    some = w != 0
    return kept[some], w[some], float(model.bias[0])


class Model(NamedTuple):
    """Feature numbers, their weights, the bias; counterfactual pairs and rows that were learnt from."""

    numbers: np.ndarray
    weights: np.ndarray
    bias: float
    pairs: int = 0
    rows: int = 0


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, penalty: float = PENALTY, chars: int = CHARS) -> Model:
    """A model of the labelled documents.

    The driver sees the features that `LEAST_DOCS` of the sampled rows share,
    of at most two times per_class rows and their counterfactuals.
    """
    labels = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), F.coalesce(F.length("text"), F.lit(0)).alias("n")).distinct()  # copies add up ahead of the shuffle
    rows = rows.join(labels, "doc_id")
    totals = dict(rows.groupBy("toxic").count().collect())
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((n1 + 0.5) / (n0 + 0.5))))

    def run(batches):
        pack = lambda f: sorted((number(k), v) for k, v in features(f).items())
        for b in batches:
            rows = []
            for doc, row, toxic, text in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                found = words(text)
                rows += [(doc, row, toxic, turn, pack(t)) for turn, t in enumerate([found, swapped(found, 1), swapped(found, 2)]) if t is not None]
            doc, row, toxic, turn, packed = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(toxic, pa.int32()), pa.array(turn, pa.int32()), pa.array([[k for k, _ in f] for f in packed], pa.list_(pa.int64())), pa.array([[v for _, v in f] for f in packed], pa.list_(pa.float32()))],
                ["doc_id", "row", "toxic", "turn", "features", "values"],
            )

    chosen = U.sampled(rows, "toxic", totals, per_class, chars, "toxicity")
    texts = U.one_text_each(docs, chosen, "toxic").select("doc_id", "row", "toxic", "text")
    table = U.spill(texts.mapInArrow(run, "doc_id long, row long, toxic int, turn int, features array<long>, values array<float>"), "features")
    common = table.where("turn = 0").select(F.explode("features").alias("f")).groupBy("f").count().where(F.col("count") >= LEAST_DOCS)
    kept = np.sort(common.select("f").toArrow().column(0).to_numpy())

    def only_kept(batches):
        for b in batches:
            f, v = b.column(4), b.column(5)
            at = np.minimum(np.searchsorted(kept, f.flatten().to_numpy()), max(0, len(kept) - 1)).astype(np.int32)
            good = kept[at] == f.flatten().to_numpy() if len(kept) else np.zeros(len(at), bool)
            size = np.bincount(np.repeat(np.arange(len(f)), f.value_lengths().to_numpy(zero_copy_only=False))[good], minlength=len(f))
            edge = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
            values = v.flatten().to_numpy()[good]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.ListArray.from_arrays(edge, pa.array(at[good])), pa.ListArray.from_arrays(edge, pa.array(values))], ["doc_id", "row", "toxic", "turn", "features", "values"])

    got = table.mapInArrow(only_kept, "doc_id long, row long, toxic int, turn int, features array<int>, values array<float>").toArrow()
    U.drop(table)
    doc, row, toxic, turn = (got.column(k).to_numpy() for k in ("doc_id", "row", "toxic", "turn"))
    numbers, values = (got.column(k).combine_chunks() for k in ("features", "values"))
    del got
    edge, numbers, values = numbers.offsets.to_numpy(), kept[numbers.values.to_numpy()], values.values.to_numpy()
    x, y, pairs = [], [], []
    for k in np.lexsort((turn, row, doc)).tolist():  # not by arrival; a counterfactual comes behind its text
        f = numbers[edge[k] : edge[k + 1]], values[edge[k] : edge[k + 1]]
        if turn[k]:
            pairs.append((len(x) - 1, f))
        else:
            x.append(f)
            y.append(float(toxic[k]))
    y = np.array(y)
    s1, s0 = y.sum(), len(y) - y.sum()
    if not s1 or not s0:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((n1 + 0.5) / (n0 + 0.5))), len(pairs), len(y))
    n_pairs, n_rows = len(pairs), len(y)
    found, weights, bias = fit(x, y, pairs, penalty)
    del x, y, pairs, edge, numbers, values
    U.trim()
    return Model(found, weights, bias + float(np.log(s0 / n0) - np.log(s1 / n1)), n_pairs, n_rows)


def score(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """All columns of docs, with the score (double, 0 to 1) behind them under a name."""
    numbers, weights, bias = model[:3]
    weight_of = dict(zip(numbers.view(np.uint64).tolist(), weights.tolist(), strict=True))
    at = docs.columns.index("text")

    def run(batches):
        from xxhash import xxh64_intdigest

        weight = weight_of.get
        seen: set[bytes] = set()  # words that were looked up, and of those with any weight it and that of their stems
        known: dict[bytes, tuple] = {}
        weighty: set[bytes] = set()
        for b in batches:
            out = []
            for text in b.column(at):
                found = (text.as_py() or "").lower().encode().translate(_SPACES).split()
                distinct = set(found)
                if len(seen) > MEMO:
                    seen.clear()
                    known.clear()
                    weighty.clear()
                new = distinct - seen
                for w in new:
                    stems = [(p, x) for p in parts(w) if (x := weight(xxh64_intdigest(p)))]
                    own = weight(xxh64_intdigest(w), 0.0)
                    if own or stems:
                        known[w] = own, stems
                        weighty.add(w)
                seen |= new
                z, stems = [bias], {}
                if hit := distinct & weighty:
                    times = Counter(w for w in found if w in hit)
                    for w, n in times.items():
                        own, listed = known[w]
                        z.append(own)
                        for p, x in listed:
                            stems[p] = (stems[p][0] + n, x) if p in stems else (n, x)
                z += [x * math.log2(1 + n) for n, x in stems.values()]
                out.append(math.fsum(z))
            p = L.sigmoid(np.array(out, np.float64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], [*(f.name for f in b.schema), name])
        del seen, known, weighty
        U.trim()

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def op8_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = U.spread(U.table(spark, sf_dir, "documents").select("doc_id", "text")), U.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = learn(docs, labels.where(U.remainder(5) != 0))
    return score(docs, model).select("doc_id", (U.remainder(5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
