"""Removal of repeated word windows, found by difference-cover anchors.

A window is `WINDOW` consecutive words of one text. Its anchors are the
shorter runs of `ANCHOR` words that start at positions in a difference cover
modulo `PERIOD`: whatever the two places of a match, some offset below the
period puts both on the cover, so both have an anchor of the same words there.

1. Anchor hashes of all texts are compared; the repeated ones go back to the
   chunks of texts that hold them.
2. Around each repeated anchor the match is extended: the windows that hold it
   get hashes, and these are compared over all texts. Texts without such
   windows are finished here.
3. Words of repeated windows are removed.

Hashes go to their chunk once, however often it holds them, so that a passage
in a third of all texts is a row per chunk and batch. Windows are equal if 96
bits of two hashes are (words themselves are not compared): of w windows around
repeated anchors, w^2 / 2^97 pairs are expected to be taken for equal wrongly,
fewer than one in 10^14 windows. A chunk finds its own repeated windows again
by 64 of these bits.

Defined results: a null text has no words; texts shorter than a window keep
all words; repeated rows repeat one another's windows; texts of any length are
worked on whole; a null doc_id stays null; nothing depends on an order, so
there are no ties; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _util as U

WINDOW = 35
#: A perfect difference set: every difference modulo 21 occurs.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
ANCHOR = WINDOW - PERIOD + 1
BASE = np.uint64(0x9E3779B97F4A7C13)  # 3 modulo 8
CHECK_BASE = np.uint64(0xD1342543DE82EF95)  # odd; of the second hash
MEMO = 400_000

SCHEMA = "doc_id long, n_words long, n_removed long, kept string, text string, times long, chunk int, h array<long>, check array<int>, many array<boolean>"


class Rolling:
    """Hashes of every run of some length of a word sequence, from powers of an odd base modulo 2^64."""

    def __init__(self, base: np.uint64 = BASE):
        self.base, self.known = base, {}
        self.up = self.down = np.ones(1, np.uint64)

    def words(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > MEMO:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def sums(self, x: np.ndarray) -> np.ndarray:
        n = len(x) + 1
        if len(self.up) < n:
            size = 1 << n.bit_length()
            inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
            self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (self.base, inverse))
        out = np.zeros(n, np.uint64)
        np.cumsum(x * self.up[: n - 1], dtype=np.uint64, out=out[1:])
        return out

    def runs(self, sums: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        h = (sums[at + length] - sums[at]) * self.down[at]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return h.view(np.int64)


def cover_positions(n_words: int, window: int = WINDOW) -> np.ndarray:
    """Anchor positions of a text; none in a text without a window."""
    if n_words < window:
        return np.zeros(0, np.int64)
    at = (np.arange(0, n_words, PERIOD)[:, None] + np.array(COVER)[None, :]).ravel()
    return at[at <= n_words - (window - PERIOD + 1)]


def covered(n: int, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the ranges first <= place < after."""
    edge = np.bincount(first, minlength=n + 1) - np.bincount(np.minimum(after, n), minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def among(h: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(h), bool)
    k = np.searchsorted(ordered, h)
    k[k == len(ordered)] = 0
    return ordered[k] == h


def other_words(x: np.ndarray) -> np.ndarray:
    """Other hashes of the same words."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def once(h: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of values, and which of them occurred more than once."""
    order = np.lexsort((check, h))
    h, check = h[order], check[order]
    start = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])])) if len(h) else np.zeros(0, np.int64)
    return h[start], check[start], np.diff(start, append=len(h)) > 1


def remove_repeats(docs: DataFrame, window: int = WINDOW, render: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept: the kept words joined by a space, or (render "sha256") their SHA-256."""
    anchor = window - PERIOD + 1
    if anchor < 1:
        raise ValueError(f"a window needs {PERIOD} words at least")
    docs, folded = U.in_chunks(docs)

    def shown(kept: bytes) -> str:
        return hashlib.sha256(kept).hexdigest() if render == "sha256" else kept.decode()

    def anchors(batches):
        r = Rolling()
        for b in batches:
            found, chunks = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for text, chunk, times in zip(b.column(0).cast(pa.binary()), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = (text.as_py() or b"").split()
                if len(words) >= window:
                    at = cover_positions(len(words), window)
                    for _ in range(min(times, 2)):  # a row that stands for several repeats itself
                        found.append(r.runs(r.sums(r.words(words)), at, anchor))
                        chunks.append(np.full(len(at), chunk, np.int32))
            h, c = np.concatenate(found), np.concatenate(chunks)
            order = np.lexsort((c, h))
            h, c = h[order], c[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            start = np.flatnonzero(new)
            many = np.diff(np.append(start, len(h))) > 1
            for k in range(0, len(start), 200_000):
                s = start[k : k + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(h[s]), pa.array(c[s]), pa.array(many[k : k + 200_000])], ["h", "chunk", "many"])

    def extend(left, right):
        """Finished rows, rows that keep their text, and the chunk's window hashes."""
        r, second, marked = Rolling(), Rolling(CHECK_BASE), np.sort(right.column("h").to_numpy())
        rows = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept", "text", "times")}
        windows, checks = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for doc, text, times in zip(left.column("doc_id").to_pylist(), left.column("text").cast(pa.binary()), left.column("times").to_pylist(), strict=True):
            text = text.as_py() or b""
            words = text.split()
            n, open_ = len(words), False
            if n >= window and len(marked):
                x = r.words(words)
                sums, at = r.sums(x), cover_positions(n, window)
                p = at[among(r.runs(sums, at, anchor), marked)]
                if len(p):
                    open_ = True
                    near = np.flatnonzero(covered(n - window + 1, np.maximum(p - PERIOD + 1, 0), np.minimum(p, n - window) + 1))
                    h, check = r.runs(sums, near, window), (second.runs(second.sums(other_words(x)), near, window) >> 32).astype(np.int32)
                    for _ in range(min(times, 2)):
                        windows.append(h)
                        checks.append(check)
            rows["doc_id"].append(doc)
            rows["n_words"].append(n)
            rows["n_removed"].append(0)
            rows["kept"].append(None if open_ else shown(b" ".join(words)))
            rows["text"].append(text.decode() if open_ else None)
            rows["times"].append(times)
        chunk = left.column("chunk")[0].as_py() if len(left) else None
        h, check, many = once(np.concatenate(windows), np.concatenate(checks))
        parts = [slice(k, k + 50_000) for k in range(0, len(h), 50_000)]
        size, more = len(rows["doc_id"]), len(parts)
        none = [None] * more
        return pa.table({
            "doc_id": pa.array(rows["doc_id"] + none, pa.int64()), "n_words": pa.array(rows["n_words"] + none, pa.int64()), "n_removed": pa.array(rows["n_removed"] + none, pa.int64()),
            "kept": pa.array(rows["kept"] + none, pa.string()), "text": pa.array(rows["text"] + none, pa.string()), "times": pa.array(rows["times"] + none, pa.int64()), "chunk": pa.array([chunk] * (size + more), pa.int32()),
            "h": pa.array([None] * size + [h[k] for k in parts], pa.list_(pa.int64())), "check": pa.array([None] * size + [check[k] for k in parts], pa.list_(pa.int32())), "many": pa.array([None] * size + [many[k] for k in parts], pa.list_(pa.bool_())),
        })

    def cut(left, right):
        r, marked = Rolling(), np.sort(right.column("h").to_numpy())
        n_removed, kept = [], []
        for text in left.column("text").cast(pa.binary()):
            words = text.as_py().split()
            n = len(words)
            i = np.flatnonzero(among(r.runs(r.sums(r.words(words)), np.arange(n - window + 1), window), marked))
            gone = covered(n, i, i + window)
            n_removed.append(int(gone.sum()))
            kept.append(shown(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])))
        return pa.table({"doc_id": left.column("doc_id"), "n_words": left.column("n_words"), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string()), "times": left.column("times")})

    marked = U.repeated(docs.select("text", "chunk", "times").mapInArrow(anchors, "h long, chunk int, many boolean"))
    seen = U.spill(docs.groupBy("chunk").cogroup(marked.groupBy("chunk")).applyInArrow(extend, SCHEMA), "extended")
    near = seen.where("h IS NOT NULL").select("chunk", F.explode(F.arrays_zip("h", "check", "many")).alias("x")).select("x.h", "x.check", "chunk", "x.many")
    open_ = seen.where("text IS NOT NULL").select("doc_id", "n_words", "text", "times", "chunk")
    done = open_.groupBy("chunk").cogroup(U.repeated(near, "check").groupBy("chunk")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept string, times long")
    out = seen.where("kept IS NOT NULL").select("doc_id", "n_words", "n_removed", "kept", "times").unionByName(done)
    out = U.spill(U.unfolded(out) if folded else out.drop("times"), "kept")
    U.drop(seen)  # with texts and windows; the result is smaller
    return out


def op4_difference_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(U.spread(U.table(spark, sf_dir, "documents").select("doc_id", "text")), render="sha256").withColumnRenamed("kept", "kept_sha256")


ORACLE_SQL = {
    "op4_difference_cover_dedup": f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words FROM documents),
windows AS (SELECT r, i, md5(array_to_string(words[i : i + {WINDOW - 1}], ' ')) AS h FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW})),
again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS pos FROM windows WHERE h IN (SELECT h FROM again)),
places AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM places ANTI JOIN gone USING (r, pos) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (r)"""
}
