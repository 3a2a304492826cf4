"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are taken in Arrow batches, equal ones are merged, and the
distinct ones are self-joined. Two fingerprints with at most `bits`
different bits agree in one of bits + 1 blocks; with that block rotated to
the front they lie under one trie node at the block's depth. Below it, node
pairs are traversed together, one bit a step: children of unlike bits add a
difference, and pairs over the budget are dropped. A task takes many small
nodes; a node of more than `most` fingerprints is split into parts, and every
two parts are a task of their own. Tasks return a spanning forest of the
links that they find, which keeps every component, and components come from
star rounds over these.

Defined results: a null or wordless text has fingerprint zero and is linked
like any other; a null doc_id keeps its row but is never a component_id (null,
if all members have none); repeated rows are returned as often as they come;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _util as U
from . import jaccard as J
from ._graph import components
from .jaccard import majority

SHINGLE = 4
BITS = 4
MOST = 50_000
#: Node pairs held at once, and the product of node sizes below which leaves are compared.
FRONTIER, LEAF = 1 << 17, 64


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text, signed 64 bits."""
    import xxhash

    w = text.lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not w:
        return 0
    if len(w) <= shingle:
        return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(w), 42)).astype(np.int64))
    n = len(w) - shingle + 1
    joined = map(b" ".join, zip(*(w[k:] for k in range(shingle)), strict=False))
    h = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(42)), np.uint64, n)
    return int(majority(h))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row, fp) of every row, row being a hash of doc_id and text."""

    def run(batches):
        for b in batches:
            texts = b.column(2).cast(pa.binary())
            fps = [fingerprint(t.as_py() or b"", shingle) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], ["doc_id", "row", "fp"])

    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text").mapInArrow(run, "doc_id long, row long, fp long")


def blocks(bits: int) -> list[tuple[int, int]]:
    """(first bit from the top, width) of bits + 1 blocks of 64 bits."""
    n = bits + 1
    edges = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def rotated(x: np.ndarray, first: int) -> np.ndarray:
    """The bit numbered `first` from the top becomes the top bit."""
    return x if first == 0 else (x << np.uint64(first)) | (x >> np.uint64(64 - first))


def trie_links(keys: np.ndarray, starts: list[tuple], depth: int, bits: int):
    """Pairs (i, j) of positions in `keys` with at most `bits` different bits.

    keys are unsigned; each start (lo, hi, lo, hi) is a pair of trie nodes,
    ranges sorted by key with equal first `depth` bits, alike or apart.
    """
    n = np.array(starts, np.int64).reshape(-1, 4)
    stack = [(depth, np.column_stack([n, np.zeros(len(n), np.int64)]))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        depth, f = stack.pop()
        if len(f) > FRONTIER:
            stack += [(depth, f[FRONTIER:]), (depth, f[:FRONTIER])]
            continue
        small = ((f[:, 1] - f[:, 0]) * (f[:, 3] - f[:, 2]) <= LEAF) | (depth == 64)
        if small.any():
            yield from leaf_links(keys, f[small], bits)
            f = f[~small]
        if not len(f):
            continue
        if depth not in ones:
            bit = (keys >> np.uint64(63 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        c = ones[depth]
        a0, a1, b0, b1, d = f.T
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])  # where the ones start
        alike = a0 == b0
        pairs = [np.column_stack([a0, am, b0, bm, d]), np.column_stack([am, a1, bm, b1, d]), np.column_stack([a0, am, bm, b1, d + 1]), np.column_stack([am, a1, b0, bm, d + 1])[~alike]]
        g = np.concatenate(pairs)
        g = g[(g[:, 0] < g[:, 1]) & (g[:, 2] < g[:, 3]) & (g[:, 4] <= bits)]
        if len(g):
            stack.append((depth + 1, g))


def leaf_links(keys: np.ndarray, f: np.ndarray, bits: int):
    na, nb = f[:, 1] - f[:, 0], f[:, 3] - f[:, 2]
    step = max(1, FRONTIER * 8 // max(1, int((na * nb).max())))
    for k in range(0, len(f), step):
        p, qa, qb = f[k : k + step], na[k : k + step], nb[k : k + step]
        size = qa * qb
        which = np.repeat(np.arange(len(p)), size)
        at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        i = p[which, 0] + at // qb[which]
        j = p[which, 2] + at % qb[which]
        keep = (p[which, 0] != p[which, 2]) | (i < j)
        i, j = i[keep], j[keep]
        near = np.bitwise_count(keys[i] ^ keys[j]) <= bits
        if near.any():
            yield i[near], j[near]


class Forest:
    """Union-find over positions; gathers the links that join two trees."""

    def __init__(self, n: int):
        self.root, self.links = np.arange(n), []

    def _find(self, x: np.ndarray) -> np.ndarray:
        while True:
            y = self.root[x]
            if (y == x).all():
                return x
            self.root[x] = self.root[y]
            x = y

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        ri, rj = self._find(i), self._find(j)
        apart = ri != rj
        if not apart.any():
            return
        _, first = np.unique(ri[apart] * np.int64(len(self.root)) + rj[apart], return_index=True)
        root = self.root
        for a, b in zip(ri[apart][first].tolist(), rj[apart][first].tolist(), strict=True):
            u, v = a, b
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
                self.links.append((u, v))


def links(fps: DataFrame, bits: int = BITS, most: int = MOST) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) that hold every component of the links of at most `bits` bits."""
    spark = fps.sparkSession
    cut = blocks(bits)
    put = F.array(*(F.struct(F.lit(j).alias("j"), F.shiftrightunsigned(F.shiftleft("fp", first), 64 - width).alias("node")) for j, (first, width) in enumerate(cut)))
    placed = fps.select("fp", F.explode(put).alias("x")).select("fp", "x.*")
    sizes = placed.groupBy("j", "node").count()
    # at most (bits + 1) * 2^width nodes, whatever the corpus: a bound for the broadcast
    large = F.broadcast(sizes.where(F.col("count") > most).select("j", "node", F.ceil(F.col("count") / most).cast("int").alias("parts")))
    n = sizes.agg(F.sum("count")).first()[0] or 0
    tasks = max(U.partitions(spark), -(-n // most))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    placed = placed.join(large, ["j", "node"], "left").withColumn("own", F.when(F.col("parts").isNotNull(), own).otherwise(-1))
    placed = placed.withColumn("other", F.explode(F.when(F.col("parts").isNotNull(), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(-1)))))
    placed = placed.select(
        "fp", "j", "own",
        F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
        F.when(F.col("parts").isNotNull(), F.col("node")).otherwise(-1 - F.pmod(F.xxhash64("j", "node"), F.lit(tasks))).alias("task"),
    )

    def run(key, t):
        j, a, b = (int(key[k].as_py()) for k in (0, 2, 3))
        first, width = cut[j]
        x = rotated(t.column("fp").to_numpy().view(np.uint64), first)
        own = t.column("own").to_numpy()
        order = np.lexsort((x, own)) if a != b else np.argsort(x)
        x = x[order]
        if a == b:  # a node or part with itself; the nodes of a task stand one after another
            top = x >> np.uint64(64 - width)
            edge = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1], [True]]))
            starts = [(lo, hi, lo, hi) for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True) if hi - lo > 1]
        else:
            m = int((own == a).sum())
            starts = [(0, m, m, len(x))]
        forest = Forest(len(x))
        if starts:
            for p, q in trie_links(x, starts, width, bits):
                forest.add(p, q)
        back = rotated(x, 64 - first if first else 0).view(np.int64)
        i = np.array(forest.links, np.int64).reshape(-1, 2)
        return pa.table({"u": pa.array(back[i[:, 0]], pa.int64()), "v": pa.array(back[i[:, 1]], pa.int64())})

    return placed.groupBy("j", "task", "a", "b").applyInArrow(run, "u long, v long")


def _classes(docs: DataFrame, shingle: int, bits: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, fp) of every row; (fp, root) of every distinct fingerprint."""
    marks = U.spill(fingerprints(docs, shingle), "fingerprints")
    distinct = U.spill(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    root = components(links(distinct.select("fp"), bits, most))
    return marks, distinct.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, most: int = MOST) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    marks, named = _classes(docs, shingle, bits, most)
    of_root = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = named.join(of_root, "root").select("fp", "component_id")
    return marks.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def trie_pairs(chosen: DataFrame, bits: int = BITS, most: int = MOST) -> DataFrame:
    """(a, b): sets of (set, fp) whose links hold every component of the links of at most `bits` bits between fingerprints.

    Sets of one fingerprint are linked to the least of them, and these as the trie links fingerprints.
    """
    least = U.spill(chosen.groupBy("fp").agg(F.min("set").alias("a")), "distinct")
    edges = links(least.select("fp"), bits, most)
    one, other = (least.select(F.col("fp").alias(e), F.col("a").alias(c)) for e, c in (("u", "a"), ("v", "b")))
    between = edges.join(one, "u").join(other, "v").select("a", "b")
    within = chosen.join(least, "fp").where("set <> a").select("a", F.col("set").alias("b"))
    return between.unionByName(within)


def representatives(docs: DataFrame, shingle: int = J.SHINGLE, similarity: tuple[int, int] = J.SIMILARITY, bits: int = BITS, most: int = J.MOST) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: that of the least doc_id (ties: the least hash of the row; rows without doc_id last).

    Texts are alike if the sets of their shingles have a Jaccard similarity of
    `similarity` or more; groups are the components of that. The trie self-join
    over the sets' SimHash links the closest ones, each link is checked against
    the texts, and `jaccard.components_of` finds what lies beyond the budget of
    `bits`: a trie can't carry the ten to fifteen differing bits of 64 that a
    similarity of 0.8 comes with. Nothing alike is missed. null and wordless texts
    are alike; repeated rows are; an empty table gives no rows.
    """
    marks = U.spill(J.marks(docs, shingle, similarity), "marks")
    chosen = U.spill(marks.groupBy("set").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("m"), F.first("fp").alias("fp"), F.first("n").alias("n")), "chosen")
    pairs = U.spill(trie_pairs(chosen.where("n > 0").select("set", "fp"), bits).distinct(), "pairs")
    root = J.components_of(docs, marks, chosen, pairs, shingle, similarity, most).withColumnRenamed("node", "set")
    kept = chosen.join(root, "set", "left").groupBy(F.coalesce("root", "set").alias("root")).agg(F.min("m").alias("m"))
    own = f"row_{uuid.uuid4().hex}"  # no column of docs has this name
    return docs.withColumn(own, F.xxhash64("doc_id", "text")).join(kept.select(F.col("m.row").alias(own)), own, "left_semi").dropDuplicates([own]).drop(own)


def op2_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(U.spread(U.table(spark, sf_dir, "documents").select("doc_id", "text")))
