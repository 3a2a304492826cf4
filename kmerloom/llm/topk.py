"""Exact top-k inner products over integer vectors, by norm order and partial sums.

Vectors are dealt by descending length into blocks. An orthogonal rotation from
the singular vectors of a sample of at most `SAMPLE` numbers puts most of every
product into the first `HEAD` dimensions (any rotation gives the same results).
Queries meet the block of the longest vectors first, which gives each a k-th
best score to beat, then seven blocks, fifty-six and so on: the score to beat
rises from round to round, so that a round's results stay a few times k for
each query. Up to `TILE` blocks and up to `TILE` query blocks meet in one task,
which reads each of them once, in the narrowest numbers that hold it; blocks
and queries whose lengths do not allow a better score (Cauchy-Schwarz) do not
meet. Within a task, blocks come in order of length, and so do the vectors of a
block: a run of them ends the search of a query once length times length cannot
reach its k-th score so far, and of the rest only those are scored exactly whose
partial sum plus the product of the residual lengths can. Bounds carry a slack
for rounding; scores are integer products. With vectors of equal length, lengths
rule nothing out, and the partial sums alone do.

Ties go to the smaller vec_id. Defined results: a component x becomes
floor(64 * x); vectors that are null or hold null or non-finite components,
and rows without vec_id, take no part; shorter vectors are taken for zero behind
their end; a query never meets rows of its own vec_id; each of repeated query
rows gets its results; scores beyond 64 bits are held at the end of their
range; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _util as U

K = 20
QUERIES_EACH = 20
BLOCK, QUERY_BLOCK, RUN, HEAD = 4096, 2048, 512, 16
#: Components of a block of vectors of many components, blocks that meet in a task on either side, numbers that the rotation is fitted on.
COMPONENTS, TILE, SAMPLE = 1 << 20, 8, 8_000_000
#: Each round takes so many times as many blocks as all before.
GROWTH = 8
SCALE = 64
SLACK = 1e-9
FOUND_SCHEMA = pa.schema([("qblock", pa.int64()), ("q", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
FOUND = "qblock long, q int, query_id long, vec_id long, score long"


def integers(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (integers held in doubles) and length of the vectors that take part."""

    def run(batches):
        for b in batches:
            ids, vs = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if i is None or not v.is_valid:
                    continue
                if v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    x = np.floor(SCALE * x)
                    if np.isfinite(x).all():
                        ids.append(i)
                        vs.append(x)
            length = [float(np.sqrt((x * x).sum())) for x in vs]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vs, pa.list_(pa.float64())), pa.array(length, pa.float64())], ["vec_id", "v", "length"])

    return embeddings.select("vec_id", F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, v array<double>, length double")


def matrix(column, d: int) -> np.ndarray:
    out = np.zeros((len(column), d))
    for k, v in enumerate(column):
        x = v.values.to_numpy(zero_copy_only=False)
        out[k, : len(x)] = x
    return out


def rotation(vectors: DataFrame, d: int, n: int) -> np.ndarray:
    """The first singular vectors, as columns, of a sample of the n vectors."""
    most = max(1, SAMPLE // d)
    low, top = -(1 << 63), (1 << 63) - 1
    mark = F.xxhash64("vec_id", "v") <= min(top, low + int((1.1 * most + 100) / max(1, n) * 2.0**64))
    x = matrix(vectors.where(mark).select("v").limit(most).toArrow().column(0), d)
    size = np.abs(x).max(axis=1, keepdims=True, initial=1)
    x = x / np.maximum(size, 1)  # no vector outweighs all others
    _, vecs = np.linalg.eigh(x.T @ x)
    return np.ascontiguousarray(vecs[:, ::-1][:, :HEAD])


def narrow(x: np.ndarray) -> tuple[str, bytes]:
    """Integers in the narrowest type that holds them."""
    most = np.abs(x).max(initial=0)
    kind = "i1" if most < 1 << 7 else "i2" if most < 1 << 15 else "i4" if most < 1 << 31 else "f8"
    return kind, x.astype(kind).tobytes()


def wide(kind: str, data: bytes, d: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, d).astype(np.float64)


def blocks(vectors: DataFrame, n: int, size: int, d: int, name: str, ordered: bool) -> DataFrame:
    """Rows of `size` of the n vectors: (name, longest, ids, kind, x), x holding the components of all vectors end to end."""
    count = max(1, -(-n // size))
    # equal lengths are split by vec_id, so that none fills a block beyond its size and the first of equals come first
    order = [F.desc("length") if ordered else F.xxhash64("vec_id"), F.col("vec_id")]
    dealt = vectors.repartitionByRange(count, *order).sortWithinPartitions(F.desc("length"), "vec_id") if count > 1 else vectors.coalesce(1).sortWithinPartitions(F.desc("length"), "vec_id")

    def run(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        ids, xs, lengths = [], [], []

        def out():
            nonlocal at, ids, xs, lengths
            i, x, length = np.concatenate(ids), np.concatenate(xs), np.concatenate(lengths)
            ids, xs, lengths = [], [], []
            for k in range(0, len(i), size):
                kind, data = narrow(x[k : k + size])
                yield pa.RecordBatch.from_arrays([pa.array([(part << 20) + at], pa.int64()), pa.array([float(length[k : k + size].max())]), pa.array([i[k : k + size].tobytes()], pa.binary()), pa.array([kind]), pa.array([data], pa.binary())], [name, "longest", "ids", "kind", "x"])
                at += 1

        for b in batches:
            if not len(b):
                continue
            ids.append(b.column(0).to_numpy())
            xs.append(matrix(b.column(1), d))
            lengths.append(b.column(2).to_numpy())
            if sum(map(len, ids)) >= 4 * size:
                yield from out()
        if ids:
            yield from out()

    return dealt.mapInArrow(run, f"{name} long, longest double, ids binary, kind string, x binary")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of rows of a with rows of b, pair by pair; held within 64 bits."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 2**53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    top, low = np.iinfo(np.int64).max, np.iinfo(np.int64).min
    return np.array([min(top, max(low, sum(int(x) * int(y) for x, y in zip(p, q, strict=True)))) for p, q in zip(a, b, strict=True)], np.int64)


class Best:
    """The best k (score, vec_id) of each query; ties to the smaller vec_id. least and last are the score and vec_id to beat."""

    def __init__(self, least: np.ndarray, last: np.ndarray, k: int):
        self.k, self.least, self.last = k, least.copy(), last.copy()
        self.score = [np.zeros(0, np.int64)] * len(least)
        self.vec = [np.zeros(0, np.int64)] * len(least)

    def add(self, q: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        order = np.argsort(q, kind="stable")
        q, vec, score = q[order], vec[order], score[order]
        edge = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1], [True]])) if len(q) else []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            i = int(q[a])
            s, v = np.concatenate([self.score[i], score[a:b]]), np.concatenate([self.vec[i], vec[a:b]])
            keep = np.lexsort((v, ~s))[: self.k]  # ~s falls as s rises, without overflow
            self.score[i], self.vec[i] = s[keep], v[keep]
            if len(keep) == self.k and float(self.score[i][-1]) >= self.least[i]:
                self.least[i], self.last[i] = float(self.score[i][-1]), self.vec[i][-1]


def beats(score: np.ndarray, vec: np.ndarray, least: np.ndarray, last: np.ndarray) -> np.ndarray:
    score = score.astype(np.float64)  # a rounded score is not below what it must beat, if the exact one is not
    return (score > least) | ((score == least) & (vec < last))


class Prepared:
    """Vectors with their lengths and what the rotation's first dimensions leave of these."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, r: np.ndarray):
        self.ids, self.x, self.most = ids, x, float(np.abs(x).max(initial=0))
        with np.errstate(over="ignore", invalid="ignore"):
            square = (x * x).sum(axis=1)
            self.head = x @ r
            rest = square - (self.head**2).sum(axis=1)
            # the difference is off by rounding, never too small here
            self.length, self.rest = np.sqrt(square), np.sqrt(np.maximum(rest, 0) + 1e-14 * square)
        self.rest[~np.isfinite(self.rest)] = np.inf


def search(q: Prepared, v: Prepared, best: Best, run: int = RUN) -> None:
    """Queries against vectors that are sorted by descending length; what beats (least, last) goes to best."""
    k = best.k
    exact = q.most * v.most * q.x.shape[1] < 2**53
    active = np.arange(len(q.x))
    for at in range(0, len(v.x), run):
        part = slice(at, at + run)
        top = float(v.length[part].max())
        active = active[~(q.length[active] * top * (1 + SLACK) + 1 < best.least[active])]
        if not len(active):
            break
        with np.errstate(over="ignore", invalid="ignore"):
            slack = SLACK * np.outer(q.length[active], v.length[part]) + 1
            bound = q.head[active] @ v.head[part].T + np.outer(q.rest[active], v.rest[part]) + slack
        can = ~(bound < best.least[active][:, None])
        can &= q.ids[active][:, None] != v.ids[part][None, :]
        if exact and can.mean() > 0.1:
            s = q.x[active] @ v.x[part].T  # integers below 2^53: exact
            can &= beats(s, v.ids[part][None, :], best.least[active][:, None], best.last[active][:, None])
            if can.sum(axis=1).max(initial=0) > 4 * k:  # the k best of each row and what ties with them
                low = np.where(can, s, -np.inf)
                kth = -np.partition(-low, k - 1, axis=1)[:, k - 1] if low.shape[1] >= k else np.full(len(low), -np.inf)
                can &= low >= kth[:, None]
            i, j = np.nonzero(can)
            best.add(active[i], v.ids[part][j], s[i, j].astype(np.int64))
        else:
            i, j = np.nonzero(can)
            s = products(q.x[active[i]], v.x[part][j])
            new = beats(s, v.ids[part][j], best.least[active[i]], best.last[active[i]]) if exact else np.ones(len(s), bool)
            best.add(active[i][new], v.ids[part][j][new], s[new])


def top_products(embeddings: DataFrame, queries, k: int = K, block: int = BLOCK, query_block: int = QUERY_BLOCK, tile: int = TILE) -> DataFrame:
    """query_id, rank, vec_id, score of the k greatest products of each row that `queries` (a condition on vec_id) selects."""
    spark = embeddings.sparkSession
    vectors = U.spill(integers(embeddings), "vectors")
    d, n, n_asked = vectors.agg(F.max(F.size("v")), F.count("*"), F.count_if(queries)).first()
    d = max(1, d or 0)
    block, query_block = (max(1, min(size, COMPONENTS // d)) for size in (block, query_block))
    r = rotation(vectors, d, n)
    candidates = U.spill(blocks(vectors, n, block, d, "block", True), "blocks")
    asked = U.spill(blocks(vectors.where(queries), n_asked, query_block, d, "qblock", False), "queries")
    U.drop(vectors)
    # fewer blocks a task where there are not tasks enough otherwise
    n_blocks, n_asked = -(-n // block), max(1, -(-n_asked // query_block))
    wide_q = max(1, min(tile, n_asked // U.partitions(spark)))
    wide_v = max(1, min(tile, n_blocks * -(-n_asked // wide_q) // (4 * U.partitions(spark))))
    seg, group = (F.floor(F.shiftright(c, 20) / w).cast("long") for c, w in (("block", wide_v), ("qblock", wide_q)))

    def meet_in_task(key, left, right):
        ordered = np.argsort(left.column("block").to_numpy())
        rows = []
        held = []
        for i in range(len(right)):
            ids = np.frombuffer(right.column("ids")[i].as_py(), np.int64)
            q = Prepared(ids, wide(right.column("kind")[i].as_py(), right.column("x")[i].as_py(), d), r)
            least, last = right.column("least")[i].as_py(), right.column("last")[i].as_py()
            least = np.frombuffer(least, np.float64) if least is not None else np.full(len(ids), -np.inf)
            last = np.frombuffer(last, np.int64) if last is not None else np.full(len(ids), np.iinfo(np.int64).max)
            held.append((right.column("qblock")[i].as_py(), q, Best(least, last, k)))
        for at in ordered.tolist():
            v = Prepared(np.frombuffer(left.column("ids")[at].as_py(), np.int64), wide(left.column("kind")[at].as_py(), left.column("x")[at].as_py(), d), r)
            for _, q, best in held:
                search(q, v, best)
        for number, q, best in held:
            size = [len(s) for s in best.score]
            which = np.repeat(np.arange(len(q.ids), dtype=np.int32), size)
            rows.append(pa.table({"qblock": pa.array(np.full(len(which), number), pa.int64()), "q": which, "query_id": q.ids[which], "vec_id": np.concatenate([np.zeros(0, np.int64), *best.vec]), "score": np.concatenate([np.zeros(0, np.int64), *best.score])}))
        return pa.concat_tables(rows) if rows else FOUND_SCHEMA.empty_table()

    def thresholds(key, left, right):
        size = len(left.column("ids")[0].as_py()) // 8
        least = np.full(size, -np.inf)
        last = np.full(size, np.iinfo(np.int64).max)
        least[right.column("q").to_numpy()] = right.column("least").to_numpy()
        last[right.column("q").to_numpy()] = right.column("last").to_numpy()
        q = wide(left.column("kind")[0].as_py(), left.column("x")[0].as_py(), d)
        # the shortest vector that could matter to some query
        with np.errstate(over="ignore"):
            length = np.sqrt((q * q).sum(axis=1))
        need = float(np.where(np.isneginf(least) | (least <= 0), 0.0, (least - 1) / np.maximum(length * (1 + SLACK), 1e-300)).min())
        return pa.table({"qblock": left.column("qblock"), "ids": left.column("ids"), "kind": left.column("kind"), "x": left.column("x"), "least": pa.array([least.tobytes()], pa.binary()), "last": pa.array([last.tobytes()], pa.binary()), "need": pa.array([need])})

    order = Window.partitionBy("qblock", "q").orderBy(F.desc("score"), "vec_id")
    found, last_block = None, candidates.agg(F.max("block")).first()[0]
    low, high = 0, 1
    while last_block is not None and low <= last_block >> 20:
        if found is None:
            ready = asked.select("qblock", "ids", "kind", "x", F.lit(None).cast("binary").alias("least"), F.lit(None).cast("binary").alias("last"), F.lit(0.0).alias("need"))
        else:
            kth = found.where(F.col("rank") == k).select(F.col("qblock").alias("of"), "q", F.col("score").alias("least"), F.col("vec_id").alias("last"))
            ready = asked.select("qblock", "ids", "kind", "x").groupBy("qblock").cogroup(kth.groupBy("of")).applyInArrow(thresholds, "qblock long, ids binary, kind string, x binary, least binary, last binary, need double")
            ready = U.spill(ready, "ready")
        part = candidates.where(F.shiftright("block", 20).between(low, high - 1)).withColumn("seg", seg)
        ready_, ready = ready, ready.withColumn("group", group)
        # lengths alone decide which groups of blocks meet; a row stands for many thousands of vectors on either side
        longest, need = part.groupBy("seg").agg(F.max("longest").alias("longest")), ready.groupBy("group").agg(F.min("need").alias("need"))
        meet = longest.join(F.broadcast(need), F.col("longest") >= F.col("need") * (1 - SLACK)).select("seg", "group")
        left = meet.join(part.drop("longest"), "seg").select(F.col("seg").alias("of_seg"), F.col("group").alias("of_group"), "block", "ids", "kind", "x")
        right = meet.join(ready.drop("need"), "group")
        new = left.groupBy("of_seg", "of_group").cogroup(right.groupBy("seg", "group")).applyInArrow(meet_in_task, FOUND)
        both = new if found is None else found.drop("rank").unionByName(new)
        before, found = found, U.spill(both.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k), "found")
        if before is not None:
            U.drop(before, ready_)
        low, high = high, high * GROWTH
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    U.drop(candidates, asked)
    return found.select("query_id", "rank", "vec_id", "score")


def op9_norm_sorted_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(U.table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERIES_EACH == 0)


ORACLE_SQL = {
    "op9_norm_sorted_products": f"""
WITH vectors AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM vectors a JOIN vectors b ON a.vec_id % {QUERIES_EACH} = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {K}"""
}
