"""Language-model scores by Brown class-based bigrams with exchange clustering.

P(w | v) = (1 - u) * (mix * P(class(w) | class(v)) * P(w | class(w)) + (1 - mix) * P0(w))
for a word of the learning texts, P0 being the base score's unigrams of these
words; u, the share of words met once (Good and Turing's estimate), goes to
the one outcome that stands for all unknown words. Class transitions are
smoothed towards class frequencies.

1. Words of all learning documents are counted.
2. Bigrams of the `FREQUENT` most frequent words (all other words taken
   together) are counted, and these words are exchanged between classes as long
   as the likelihood of the class bigrams rises.
3. Every other word is put in by the same criterion: texts are dealt into
   chunks, each chunk counts the classes left and right of its words, the counts
   are added up by word, and the word goes to the class that its neighbours make
   likeliest. It is put in once, and not exchanged again.
4. The class and count of each word go back to the chunks that hold it; texts
   become sequences of classes and counts, and class transitions are counted
   over all learning texts.
5. Texts are scored.

Counts of words, contexts and transitions cover all learning documents. No
vocabulary is broadcast: a chunk gets the entries of its own words, so memory
is bounded by the chunk. A word in all chunks is one row of at most twice as
many counts as there are classes from each, which are added up in a stream. The
driver sees the counts of frequent words and the class matrix, both of fixed
size.

Defined results: a null text is an empty one, whose only token is the end; a
null doc_id counts as the empty text for the fold and stays null; repeated
rows count as often as they come; texts of any length are scored whole; of
words equally frequent the first in order of bytes is among the `FREQUENT`, of
equally likely classes the first is taken; without learning documents the base
probability of every token is 1 and the score is that of an unknown token; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _util as U

FREQUENT = 1000
CLASSES = 32
MIX = 0.9
ROUNDS = 10
ADD = 0.1
#: Weight of class frequencies in class transitions.
PRIOR = 5.0
#: Words that a task counts before it hands them on.
HELD = 400_000
#: The most that one entry of a word's contexts counts.
MOST_COUNT = (1 << 24) - 1


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts."""

    def run(batches):
        held: Counter = Counter()

        def out():
            items = list(held.items())
            for k in range(0, len(items), 100_000):
                part = items[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()), pa.array([n for _, n in part], pa.int64())], ["word", "n"])
            held.clear()

        for b in batches:
            for t in b.column(0):
                held.update(words(t.as_py()))
                if len(held) > HELD:
                    yield from out()
        yield from out()

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_bigrams(texts: DataFrame, frequent: list[bytes]) -> np.ndarray:
    """Counts of neighbours among frequent words, all others (number m) and the ends of texts (number m + 1)."""
    m = len(frequent)
    size = m + 2
    numbers = {w: k for k, w in enumerate(frequent)}

    def run(batches):
        total = np.zeros(size * size, np.int64)
        for b in batches:
            for t in b.column(0):
                w = words(t.as_py())
                x = np.full(len(w) + 2, m + 1, np.int64)
                x[1:-1] = np.fromiter(map(numbers.get, w, repeat(m)), np.int64, len(w))
                pairs = x[:-1] * size + x[1:]
                if len(pairs) > size * size // 4:
                    total += np.bincount(pairs, minlength=size * size)
                else:
                    np.add.at(total, pairs, 1)
        some = np.flatnonzero(total)
        for k in range(0, len(some), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(some[k : k + 100_000].astype(np.int32)), pa.array(total[some[k : k + 100_000]])], ["k", "n"])

    got = texts.select("text").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # size * size rows at most
    counts = np.zeros(size * size, np.int64)
    counts[got.column("k").to_numpy()] = got.column("n").to_numpy()
    return counts.reshape(size, size)


def entropy_terms(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, n_classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the frequent words, and the counts between classes (the two last: other words, ends of texts).

    A word moves to the class that raises the sum of n log n over class pairs,
    less that over classes as left and as right neighbours, the most.
    """
    m = len(bigrams) - 2
    n_classes = max(1, min(n_classes, m))
    of = np.concatenate([np.arange(m) % n_classes, [n_classes, n_classes + 1]])
    size = n_classes + 2
    b = bigrams.astype(float)
    one = np.zeros((m + 2, size))
    one[np.arange(m + 2), of] = 1
    c = one.T @ b @ one
    for _ in range(rounds):
        moved = 0
        for w in range(m):
            own = of[w]
            right = np.bincount(of, b[w], minlength=size)
            left = np.bincount(of, b[:, w], minlength=size)
            self_ = b[w, w]
            right[own] -= self_
            left[own] -= self_
            # without the word
            c[own, :] -= right
            c[:, own] -= left
            c[own, own] -= self_
            rows, cols = c.sum(axis=1), c.sum(axis=0)
            k = np.arange(n_classes)
            gain = (entropy_terms(c[:n_classes] + right) - entropy_terms(c[:n_classes])).sum(axis=1)
            gain += (entropy_terms(c[:, :n_classes] + left[:, None]) - entropy_terms(c[:, :n_classes])).sum(axis=0)
            both = c[k, k]
            gain += entropy_terms(both + right[:n_classes] + left[:n_classes] + self_) - entropy_terms(both + right[:n_classes]) - entropy_terms(both + left[:n_classes]) + entropy_terms(both)
            r, s = right.sum() + self_, left.sum() + self_
            gain -= entropy_terms(rows[:n_classes] + r) - entropy_terms(rows[:n_classes])
            gain -= entropy_terms(cols[:n_classes] + s) - entropy_terms(cols[:n_classes])
            to = int(np.argmax(gain))
            if gain[to] <= gain[own] + 1e-9:
                to = own
            moved += to != own
            of[w] = to
            c[to, :] += right
            c[:, to] += left
            c[to, to] += self_
        if not moved:
            break
    return of[:m], c


def affinities(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a left, and a right, neighbour's class adds to the log likelihood of each word class."""
    n = c.shape[0] - 2
    s = c + 0.5
    pmi = np.log(s) - np.log(s.sum(axis=1, keepdims=True)) - np.log(s.sum(axis=0, keepdims=True)) + np.log(s.sum())
    return pmi[:, :n], pmi[:n, :].T


def score_texts(docs: DataFrame, held_out: int = 10, frequent: int = FREQUENT, n_classes: int = CLASSES, mix: float = MIX) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    texts = docs.where(U.remainder(held_out) != 0).select("text")
    docs, folded = U.in_chunks(docs)
    docs = docs.select("doc_id", "text", "times", "chunk", (U.remainder(held_out) == 0).alias("held_out"))
    counts = U.spill(word_counts(texts), "words")
    n_words, distinct, once = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1)).first()
    n_docs = texts.count()
    total, v = n_words + n_docs, distinct + (n_docs > 0)
    top = counts.orderBy(F.desc("n"), "word").limit(frequent).collect()
    top_words = [bytes(r[0]) for r in top]
    classes, between = exchange(frequent_bigrams(texts, top_words), n_classes)
    size = between.shape[0]
    other, end = size - 2, size - 1
    n_cls = other
    class_of = dict(zip(top_words, classes.tolist(), strict=True))
    count_of = {bytes(r[0]): r[1] for r in top}
    by_left, by_right = affinities(between)

    def contexts(t):
        """Of every word of the chunk but the frequent ones: how often each class stands left (number c) and right (size + c) of it in learning texts."""
        number = defaultdict(count().__next__)
        runs, times = [np.array([-1], np.int32)], [1]  # texts to learn from, with -1 at every end
        for text, held, n in zip(t.column("text"), t.column("held_out").to_pylist(), t.column("times").to_pylist(), strict=True):
            w = words(text.as_py())
            k = np.fromiter(map(number.__getitem__, w), np.int32, len(w))
            if not held:
                runs += [k, runs[0]]
                times.append(n)
        names, k = list(number), np.concatenate(runs)
        class_at = np.array([*map(class_of.get, names, repeat(other)), end], np.uint8)
        c = class_at[k]
        rare = np.flatnonzero((c == other) & (k >= 0))
        key = np.concatenate([k[rare] * np.int64(2 * size) + c[rare - 1], k[rare] * np.int64(2 * size) + size + c[rare + 1]])
        if max(times) > 1:
            weight = np.repeat(times, [1, *(len(x) + 1 for x in runs[1::2])])[rare]
            key, at = np.unique(key, return_inverse=True)
            n = np.bincount(at, np.concatenate([weight, weight])).astype(np.int64)
        else:
            key, n = np.unique(key, return_counts=True)
        word, slot = key // (2 * size), key % (2 * size)
        once = n == 1
        many = np.flatnonzero(~once)
        pieces = -(-n[many] // MOST_COUNT)  # counts of more than 24 bits come in several
        many = np.repeat(many, pieces)
        last = np.cumsum(pieces) - 1
        part = np.full(len(many), MOST_COUNT)
        part[last] = n[many[last]] - (pieces - 1) * MOST_COUNT
        packed = (slot[many] << 24 | part).astype(np.uint32)
        keep = class_at[:-1] == other
        lists = lambda of, width, data: pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(names)) * width)]).astype(np.int32)), pa.py_buffer(data.tobytes())])
        chunk = pa.array(np.full(len(names), t.column("chunk")[0].as_py(), np.int32))
        columns = {"word": pa.array(names, pa.binary()), "chunk": chunk, "once": lists(word[once], 1, slot[once].astype(np.uint8)), "many": lists(word[many], 4, packed)}
        return pa.table(columns).filter(pa.array(keep, pa.bool_()))

    def assign(batches):
        """Count and class of each word, for each chunk that holds it; rows come in order of words.

        Of a word that goes on in the next batch, its counts so far and the numbers of its chunks are kept.
        """
        names = ["word", "chunk", "n", "cls"]

        def flat(column, kind):
            column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            data = column.buffers()[2]
            values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind) if data is not None and offsets[-1] > offsets[0] else np.zeros(0, kind)
            return values, np.diff(offsets) // np.dtype(kind).itemsize

        def rows(words_, chunks, which, total):
            left = total[:, :size].sum(axis=1)
            cls = np.argmax(total[:, :size] @ by_left + total[:, size:] @ by_right, axis=1).astype(np.int32) if n_cls else np.zeros(len(total), np.int32)
            known = left[which] > 0
            out = pa.RecordBatch.from_arrays([words_, chunks, pa.array(left[which].astype(np.int64)), pa.array(cls[which])], names)
            return out.filter(pa.array(known))

        held_word, held_total, held_chunks = None, None, []

        def release():
            chunks = np.concatenate(held_chunks)
            for k in range(0, len(chunks), 100_000):
                part = chunks[k : k + 100_000]
                yield rows(pa.array([held_word] * len(part), pa.binary()), pa.array(part), np.zeros(len(part), np.int64), held_total[None])

        for b in batches:
            if not b.num_rows:
                continue
            py = b.column(0).to_pylist()
            new = np.array([True, *(x != y for x, y in zip(py, py[1:], strict=False))])
            run = np.cumsum(new) - 1
            n_runs = int(run[-1]) + 1
            slots, n1 = flat(b.column(2), np.uint8)
            packed, n2 = flat(b.column(3), np.uint32)
            total = np.bincount(np.repeat(run, n1) * 2 * size + slots, minlength=n_runs * 2 * size).astype(float)
            total += np.bincount(np.repeat(run, n2) * 2 * size + (packed >> 24), packed & 0xFFFFFF, minlength=n_runs * 2 * size)
            total = total.reshape(n_runs, 2 * size)
            chunks = b.column(1).to_numpy()
            start = np.flatnonzero(new)
            first = 0
            if held_word is not None and py[0] == held_word:
                held_total = held_total + total[0]
                held_chunks.append(chunks[: start[1] if n_runs > 1 else None])
                first = 1
            if first < n_runs:  # the held word is whole; the batch's last one may go on
                if held_word is not None:
                    yield from release()
                lo, hi = start[first], start[-1]
                if hi > lo:
                    yield rows(b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), run[lo:hi] - first, total[first:-1])
                held_word, held_total, held_chunks = py[-1], total[-1], [chunks[hi:]]
        if held_word is not None:
            yield from release()

    def encode(left, right):
        """Texts as classes and counts, with base scores; and the chunk's class transitions (unknown words: class size)."""
        names = right.column("word").to_pylist()
        number = dict(zip(names, range(len(names)), strict=True))
        for k, w in enumerate(top_words):
            number[w] = len(names) + k
        n_of = np.concatenate([right.column("n").to_numpy(), [count_of[w] for w in top_words], [n_docs, 0]]).astype(np.uint32 if total < 1 << 32 else np.int64)
        c_of = np.concatenate([right.column("cls").to_numpy(), classes, [end, size]]).astype(np.uint8)
        base_of = np.log10((n_of + ADD) / (total + ADD * (v + 1)))
        last, unknown = len(n_of) - 2, len(n_of) - 1
        ends, runs, sizes = np.array([last], np.int32), [], []
        for text in left.column("text"):
            w = words(text.as_py())
            runs += [np.fromiter(map(number.get, w, repeat(unknown)), np.int32, len(w)), ends]
            sizes.append(len(w) + 1)
        k, start = np.concatenate(runs), np.concatenate([[0], np.cumsum(sizes)])
        n, c = n_of[k], c_of[k]
        before = np.concatenate([[end], c[:-1]])  # every text ends with the end, which comes before the next one's first token
        weight = np.repeat(np.where(left.column("held_out").to_numpy(), 0, left.column("times").to_numpy()), sizes)
        moves = np.bincount(before.astype(np.int64) * (size + 1) + c, weight, minlength=(size + 1) ** 2).astype(np.int64)
        binary = lambda values, width: pa.concat_arrays([pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((start * width).astype(np.int32)), pa.py_buffer(values)]), pa.nulls(1, pa.binary())])
        return pa.table({
            "doc_id": pa.array([*left.column("doc_id").to_pylist(), None], pa.int64()),
            "held_out": pa.array([*left.column("held_out").to_pylist(), None], pa.bool_()),
            "n_tokens": pa.array([*sizes, None], pa.int64()), "n_known": pa.array([*np.add.reduceat((n > 0).astype(np.int64), start[:-1]).tolist(), None], pa.int64()),
            "base_score": pa.array([*np.add.reduceat(base_of[k], start[:-1]).tolist(), None], pa.float64()),
            "times": pa.array([*left.column("times").to_pylist(), None], pa.int64()), "classes": binary(c.tobytes(), 1), "counts": binary(n.tobytes(), n.itemsize),
            "moves": pa.array([None] * len(sizes) + [moves.tolist()], pa.list_(pa.int64())),
        })

    by_word = docs.groupBy("chunk").applyInArrow(contexts, "word binary, chunk int, once binary, many binary")
    by_word = by_word.repartition(U.partitions(docs.sparkSession), "word").sortWithinPartitions("word")
    entries = by_word.mapInArrow(assign, "word binary, chunk int, n long, cls int")
    encoded = docs.groupBy("chunk").cogroup(entries.groupBy("chunk")).applyInArrow(encode, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, times long, classes binary, counts binary, moves array<long>")
    encoded = U.spill(encoded, "encoded")

    moves = np.zeros((size + 1) ** 2)
    for k, n in encoded.where("moves IS NOT NULL").select(F.posexplode("moves").alias("k", "n")).groupBy("k").agg(F.sum("n")).collect():  # a fixed number of rows
        moves[k] = n
    moves = moves.reshape(size + 1, size + 1)
    class_total = moves.sum(axis=0)
    share = class_total / max(1.0, class_total.sum())
    step = (moves + PRIOR * share) / np.maximum(moves.sum(axis=1, keepdims=True) + PRIOR, 1e-300)
    per_count = mix * step / np.maximum(class_total, 1)  # times a word's count: the class part of its probability
    wide = total >= 1 << 32
    unseen = (once + ADD) / (total + ADD * (v + 1))
    seen = 1 - ADD / (total + ADD * (v + 1))  # what the base model leaves to known words

    def finish(batches):
        for b in batches:
            out = []
            for c, n in zip(b.column(6), b.column(7), strict=True):
                c = np.frombuffer(c.as_py(), np.uint8)
                n = np.frombuffer(n.as_py(), np.int64 if wide else np.uint32).astype(float)
                before = np.concatenate([[end], c[:-1]])
                base = (n + ADD) / (total + ADD * (v + 1))
                p = (1 - unseen) * (per_count[before, c] * n + (1 - mix) * base / max(seen, ADD))
                out.append(float(np.log10(np.where(n > 0, p, unseen)).sum()))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(np.full(len(b), total), pa.int64()), b.column(4), pa.array(out, pa.float64()), b.column(5)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "times"])

    scored = encoded.where("moves IS NULL").drop("moves").mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, times long")
    out = U.spill(U.unfolded(scored) if folded else scored.drop("times"), "scores")
    U.drop(counts, encoded)  # a number for every token; the result has a row for every text
    return out


def op3_class_exchange_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(U.spread(U.table(spark, sf_dir, "documents").select("doc_id", "text")))
