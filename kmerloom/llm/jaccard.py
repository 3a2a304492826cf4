"""Documents whose sets of word shingles have a Jaccard similarity of some value or more, found exactly.

Completes what the SimHash trie finds (`simhash.representatives`): its
error budget reaches near-identical texts, this search misses no pair. The
shingles of every text (`SHINGLE` words, A-Z lowered, ASCII white space splits)
are put in one common order, seldom ones first, and of n shingles the first
n - ceil(s n) + 1 are dealt out; two sets of similarity s share one of these
whatever the order is. The order comes from counts of hashed shingles, so
collisions and counts change the work and never the result.

Sets that share a dealt shingle make a list. Lists of up to `SMALL` sets give
their pairs, which are few for each set and mostly the same from list to list;
larger ones are searched in two rounds: pairs of different components, as many
as could join them in a forest, then all pairs that are still in different
components. Lists of more than `MOST` sets are split into parts, every two parts
a task of their own. A pair is kept by sizes, positions and sketches, which rule
out no similar pair, before its texts are fetched and compared.

Defined results: shingles and sets are told apart by 64-bit hashes; a text of
fewer words than a shingle is one shingle; null and wordless texts are alike.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _util as U
from ._graph import components, grown

SHINGLE = 5
#: As a fraction, so that no pair is decided by rounding.
SIMILARITY = (4, 5)
#: Parities of a sketch; sets of more than twice as many shingles have LONG times as many.
BITS, LONG = 1024, 8
#: Hashed counts that give the order, and texts that are looked up by broadcast.
COUNTS, BROADCAST_TEXTS = 1 << 20, 200_000
#: Sets of a list whose pairs are given at once, of a part of a list, and rows that a task works on together.
SMALL, MOST, ROWS = 32, 20_000, 100_000


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of a UTF-8 text's shingles, sorted, each once."""
    import xxhash

    w = text.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    n = max(1, len(w) - shingle + 1)
    joined = map(b" ".join, zip(*(w[k : k + n] for k in range(min(shingle, len(w)))), strict=True))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(42)), np.uint64, n))


def majority(h: np.ndarray) -> np.int64:
    """SimHash: bit by bit, 1 if set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 255 * 256):
        bits = np.unpackbits(h[k : k + 255 * 256].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = len(bits) // 255 * 255
        if full:  # sums of 255 ones fit eight bits
            ones += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[full:].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0]


def similar(a: np.ndarray, b: np.ndarray, similarity: tuple[int, int] = SIMILARITY) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * similarity[1] >= similarity[0] * (len(a) + len(b) - both)


def sketch(h: np.ndarray) -> bytes:
    """Parities of a set's hashes: the bits in which two differ are at most the hashes that only one set has."""
    size = BITS if len(h) <= 2 * BITS else BITS * LONG
    odd = np.bincount((h >> np.uint64(40)).astype(np.int64) % size, minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _words(bits: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words; those of more bits folded, which keeps parities."""
    width = BITS // 8
    short = [b if len(b) == width else np.bitwise_xor.reduce(np.frombuffer(b, np.uint8).reshape(-1, width)).tobytes() for b in bits]
    return np.frombuffer(b"".join(short), np.uint64).reshape(-1, BITS // 64)


def _room(apart: np.ndarray, n: np.ndarray, m: np.ndarray, num: int, den: int):
    """If so many differing parities leave room for similar sets of n and m shingles: these differ in (n + m) (den - num) / (den + num) at most."""
    return apart * (num + den) <= (n + m) * (den - num)


def _possible(x: np.ndarray, y: np.ndarray, i, j, bits_x: list[bytes], bits_y: list[bytes], n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of the pairs x[i], y[j] of sketches leave room; of two long ones all parities are compared."""
    ok = _room(np.bitwise_count(x[i] ^ y[j]).sum(axis=1, dtype=np.int64), n, m, num, den)
    for k in np.flatnonzero(ok & (n > 2 * BITS) & (m > 2 * BITS)).tolist():
        p, q = (np.frombuffer(z[at[k]], np.uint64) for z, at in ((bits_x, i), (bits_y, j)))
        ok[k] = _room(int(np.bitwise_count(p ^ q).sum()), int(n[k]), int(m[k]), num, den)
    return ok


def _counts(docs: DataFrame, shingle: int) -> np.ndarray:
    """How often shingles of each hash modulo COUNTS occur, up to 32 bits."""
    parts = 16

    def count(batches):
        total, held, n = np.zeros(COUNTS, np.int64), [np.empty(0, np.int64)], 0
        for b in batches:
            for t in b.column(0).cast(pa.binary()):
                held.append((shingle_set(t.as_py() or b"", shingle) % np.uint64(COUNTS)).astype(np.int64))
                n += len(held[-1])
                if n > COUNTS:
                    total += np.bincount(np.concatenate(held), minlength=COUNTS)
                    held, n = [np.empty(0, np.int64)], 0
        total += np.bincount(np.concatenate(held), minlength=COUNTS)
        cut = np.minimum(total, 0xFFFFFFFF).astype(np.uint32).reshape(parts, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([x.tobytes() for x in cut], pa.binary())], ["part", "counts"])

    def add(key, t):
        total = np.zeros(COUNTS // parts, np.int64)
        for x in t.column("counts"):
            total += np.frombuffer(x.as_py(), np.uint32)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())})

    out = np.zeros((parts, COUNTS // parts), np.uint32)
    for r in docs.select("text").mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect():
        out[r["part"]] = np.frombuffer(r["counts"], np.uint32)
    return out.reshape(-1)


def marks(docs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(doc_id, row, set, n, fp, first, bits) of every row: hashes of the row and of its set, the set's size and SimHash; the shingles that are dealt out and the sketch (once for each set and task, mostly)."""
    counts, (num, den) = _counts(docs, shingle), similarity

    def run(batches):
        import xxhash

        seen: dict[int, int] = {}
        for b in batches:
            sets, sizes, fps, first, bits = [], [], [], [], []
            for t in b.column(2).cast(pa.binary()):
                h = shingle_set(t.as_py() or b"", shingle)
                key = int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), 42)).astype(np.int64))
                sets.append(key)
                sizes.append(len(h))
                if not len(h) or key in seen:
                    fps.append(seen.get(key, 0))
                    first.append(None)
                    bits.append(None)
                    continue
                fps.append(int(majority(h)))
                if len(seen) < 200_000:
                    seen[key] = fps[-1]
                dealt = len(h) + (-num * len(h) // den) + 1
                first.append(h[np.lexsort((h, counts[h % np.uint64(COUNTS)]))][:dealt].view(np.int64))
                bits.append(sketch(h))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(sets, pa.int64()), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), pa.array(first, pa.list_(pa.int64())), pa.array(bits, pa.binary())], ["doc_id", "row", "set", "n", "fp", "first", "bits"]
            )

    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text").mapInArrow(run, "doc_id long, row long, set long, n int, fp long, first array<long>, bits binary")


def _admissible(n, i, m, j, num: int, den: int):
    """If sets of n and m shingles with one in common, the i-th and the j-th, can be similar."""
    sizes = den * np.minimum(n, m) >= num * np.maximum(n, m)
    return sizes & ((num + den) * (np.minimum(i, j) + np.minimum(n - i, m - j)) >= num * (n + m))


def lists(dealt: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Of (h, set, n, pos): pairs (a, n_a, b, n_b) of small lists that can be similar, with h null, and the rows (h, set as a, n as n_a, pos) of larger ones.

    Rows are dealt by h and sorted; a list that fills batches is passed on.
    """
    num, den = similarity

    def run(batches):
        none = np.zeros(0, np.int64)
        held = [none] * 4
        large, last = None, None  # the list that is being passed on, and its last set

        def rows(h, s, n, pos):
            for k in range(0, len(h), ROWS):
                p = slice(k, k + ROWS)
                size = len(h[p])
                yield pa.RecordBatch.from_arrays([pa.array(h[p]), pa.array(s[p]), pa.array(n[p], pa.int32()), pa.array(pos[p], pa.int32()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int32())], NAMES)

        def whole(h, s, n, pos):
            """Lists that are complete."""
            edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]])) if len(h) else none
            size = np.repeat(np.diff(edge), np.diff(edge))
            many = (size > SMALL) | ((h == large) if large is not None else False)
            yield from rows(h[many], s[many], n[many], pos[many])
            keep = (size > 1) & ~many
            h, s, n, pos = (x[keep] for x in (h, s, n, pos))
            for d in range(1, SMALL):
                i = np.flatnonzero(h[d:] == h[:-d])
                if not len(i):
                    break
                j = i + d
                ok = _admissible(n[i], pos[i], n[j], pos[j], num, den)
                i, j = i[ok], j[ok]
                for k in range(0, len(i), ROWS):
                    x, y = i[k : k + ROWS], j[k : k + ROWS]
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(x), pa.int64()), pa.array(s[x]), pa.array(n[x], pa.int32()), pa.nulls(len(x), pa.int32()), pa.array(s[y]), pa.array(n[y], pa.int32())], NAMES)

        for b in batches:
            if not b.num_rows:
                continue
            cols = [np.concatenate([x, b.column(k).to_numpy().astype(np.int64)]) for k, x in enumerate(held)]
            once = np.ones(len(cols[0]), bool)
            once[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
            once[0] = (cols[0][0], cols[1][0]) != (large, last)
            end = cols[0][-1]
            cols = [x[once] for x in cols]
            done = np.searchsorted(cols[0], end)
            yield from whole(*(x[:done] for x in cols))
            held = [x[done:] for x in cols]
            if end == large or len(held[0]) > SMALL:
                if len(held[0]):
                    yield from rows(*held)
                    large, last = end, held[1][-1]
                held = [none] * 4
        yield from whole(*held)

    return dealt.repartition(U.partitions(dealt.sparkSession), "h").sortWithinPartitions("h", "set").mapInArrow(run, "h long, a long, n_a int, pos int, b long, n_b int")


NAMES = ["h", "a", "n_a", "pos", "b", "n_b"]


def likely(pairs: DataFrame, sketches: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose sketches leave room."""
    num, den = similarity

    def run(batches):
        for b in batches:
            if b.num_rows:
                n, m = (b.column(k).to_numpy().astype(np.int64) for k in (2, 3))
                x, y = b.column(4).to_pylist(), b.column(5).to_pylist()
                at = np.arange(len(n))
                keep = pa.array(_possible(_words(x), _words(y), at, at, x, y, n, m, num, den))
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    one, other = (sketches.select(F.col("set").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in ("a", "b"))
    return pairs.select("a", "b").join(one.hint("merge"), "a").join(other.hint("merge"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def apart(large: DataFrame, root: DataFrame, sketches: DataFrame, similarity: tuple[int, int], forest: bool, most: int = MOST) -> DataFrame:
    """(a, b): admissible pairs of a large list that lie in different components; forest: of a group of lists, only those that join two trees."""
    num, den = similarity

    def groups(batches):
        """Tables of whole parts of lists, ROWS or more together (but for the last)."""
        held = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) < ROWS:
                continue
            t = pa.Table.from_batches(held)
            key = [t.column(k).to_numpy() for k in range(3)]
            same = np.logical_and.reduce([k == k[-1] for k in key])
            cut = int(np.argmax(same))
            if cut:
                yield t.slice(0, cut)
                held = t.slice(cut).to_batches()
        if held:
            yield pa.Table.from_batches(held)

    def run(batches):
        for t in groups(batches):
            h, p, q, own, s, n, pos, r = (t.column(k).to_numpy().astype(np.int64) for k in range(8))
            # every sketch once
            sets, at, which = np.unique(s, return_index=True, return_inverse=True)
            bits = t.column(8).take(pa.array(at)).to_pylist()
            words = _words(bits)
            names, r = np.unique(r, return_inverse=True)
            up, merged = list(range(len(names))), 0

            def top(x, up=up):
                while up[x] != x:
                    up[x] = up[up[x]]
                    x = up[x]
                return x

            seen: set[tuple[int, int]] = set()
            i, d = np.arange(len(h)), 0
            while len(i):  # sets grow along a list: a pair too unlike in size ends its row
                d += 1
                i = i[i + d < len(h)]
                j = i + d
                go = (h[i] == h[j]) & (p[i] == p[j]) & (q[i] == q[j]) & (den * n[i] >= num * n[j])
                i, j = i[go], j[go]
                hit = (r[i] != r[j]) & ((p[i] == q[i]) | (own[i] != own[j])) & _admissible(n[i], pos[i], n[j], pos[j], num, den)
                x, y = i[hit], j[hit]
                for k in range(0, len(x), 1 << 15):
                    u, v = x[k : k + (1 << 15)], y[k : k + (1 << 15)]
                    u, v = (z[r[u] != r[v]] for z in (u, v))
                    ok = _possible(words, words, which[u], which[v], bits, bits, n[u], n[v], num, den)
                    u, v = u[ok], v[ok]
                    out = []
                    for a, b, ra, rb in zip(*(z.tolist() for z in (s[u], s[v], r[u], r[v])), strict=True):
                        if forest:
                            ra, rb = top(ra), top(rb)
                            if ra != rb:
                                up[ra] = rb
                                merged += 1
                                out.append((a, b))
                        elif (a, b) not in seen:
                            if len(seen) > 200_000:
                                seen.clear()
                            seen.add((a, b))
                            out.append((a, b))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array([z[0] for z in out]), pa.array([z[1] for z in out])], ["a", "b"])
                    if merged > len(up) // 16:  # pairs of one tree are passed over from here on
                        r, merged = np.array([top(z) for z in range(len(up))])[r], 0

    named = large.select("h", F.col("a").alias("set"), F.col("n_a").alias("n"), "pos").join(root.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    several = named.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.ceil(F.count("*") / most).cast("int").alias("parts")).where("x <> y").select("h", "parts")
    rows = named.join(several, "h").join(sketches.select("set", "bits"), "set").withColumn("own", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("h", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "set", "n", "pos", "root", "bits")
    dealt = rows.repartition(U.partitions(large.sparkSession), "h", "p", "q").sortWithinPartitions("h", "p", "q", "n", "set")
    return dealt.mapInArrow(run, "a long, b long")


def verified(docs: DataFrame, chosen: DataFrame, pairs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(u, v), stored: the pairs (a, b) of sets that are similar. chosen: (set, m.row), a row that has the set."""

    def run(batches):
        last, of_last = None, None
        for b in batches:
            keep = []
            for a, x, y in zip(b.column(0).to_pylist(), b.column(2).cast(pa.binary()), b.column(3).cast(pa.binary()), strict=True):
                if a != last:
                    last, of_last = a, shingle_set(x.as_py() or b"", shingle)
                keep.append(similar(of_last, shingle_set(y.as_py() or b"", shingle), similarity))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["u", "v"])

    needed = U.spill(pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct().join(chosen.select("set", F.col("m.row").alias("row")), "set"), "needed")
    held = F.broadcast if needed.count() <= BROADCAST_TEXTS else lambda df: df
    texts = U.spill(docs.select(F.xxhash64("doc_id", "text").alias("row"), "text").join(held(needed), "row").groupBy("set").agg(F.min("text").alias("text")), "texts")
    one, other = (texts.select(F.col("set").alias(c), F.col("text").alias(f"text_{c}")) for c in ("a", "b"))
    both = pairs.join(one.hint("merge"), "a").join(other.hint("merge"), "b").select("a", "b", "text_a", "text_b")
    out = U.spill(both.mapInArrow(run, "u long, v long"), "links")
    U.drop(needed, texts)
    return out


def components_of(docs: DataFrame, marks: DataFrame, chosen: DataFrame, pairs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, most: int = MOST) -> DataFrame:
    """(node, root) of all sets that are similar to another one, from marks (see above), chosen (set, m.row) and stored pairs (a, b) to be tried first."""
    listed = U.spill(lists(marks.select("set", "n", F.posexplode("first").alias("pos", "h")).select("h", "set", "n", "pos"), similarity), "lists")
    some = listed.select(F.explode(F.array("a", "b")).alias("set")).where("set IS NOT NULL").distinct()
    sketches = U.spill(marks.where("bits IS NOT NULL").join(some, "set", "left_semi").select("set", "n", "bits").dropDuplicates(["set"]), "sketches")
    small = listed.where("h IS NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried = U.spill(likely(small, sketches, similarity).unionByName(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct(), "pairs")
    stored = [listed, sketches, tried]
    root = components(verified(docs, chosen, tried, shingle, similarity))
    large = listed.where("h IS NOT NULL")
    for forest in () if large.isEmpty() else (True, False):
        rest = apart(large, root, sketches, similarity, forest, most).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        rest = U.spill(rest.join(tried, ["a", "b"], "left_anti"), "pairs")
        stored.append(rest)
        if not rest.isEmpty():
            tried = tried.unionByName(rest)
            root = grown(root, verified(docs, chosen, rest, shingle, similarity))
    U.drop(*stored)
    return root
