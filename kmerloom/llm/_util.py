"""Shared parts of the corpus operators: tables, scratch space, chunks, sorted duplicate detection."""

from __future__ import annotations

import re
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Text held together in one Python group, in characters.
CHUNK_CHARS = 12_000_000

#: Seconds between two collections on the driver.
COLLECT_S = 5.0

_collected = 0.0
_own_dirs: dict[str, str] = {}
_spilled: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals rows to all cores where there are fewer partitions than cores, as of one small file; else as read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Where none is set, a temporary one on this machine: for one machine only, an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors share ({master})")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="kmerloom-")
    return _own_dirs[app]


def spill(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/kmerloom-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _collect(spark)
    _spilled.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kmerloom_path = path
    return out


def _collect(spark: SparkSession) -> None:
    """Has the driver forget plans that are done: Spark deletes shuffle files and broadcasts once their plans are collected, and else only when the driver's heap is full."""
    global _collected
    if time.monotonic() - _collected > COLLECT_S:
        spark.range(1).count()  # listeners hold on to the last plan until another one ends
        spark.sparkContext._jvm.java.lang.System.gc()
        _collected = time.monotonic()


def trim() -> None:
    """Gives memory that is free back to the system: workers live on, and the next task needs it elsewhere."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop(*spilled: DataFrame) -> None:
    """Deletes tables that `spill` gave and that nothing reads any more."""
    for df in spilled:
        spark, path = df.sparkSession, df._kmerloom_path
        _spilled[spark.sparkContext.applicationId].remove(path)
        _delete(spark, path)


def clear(spark: SparkSession) -> None:
    """Deletes all that `spill` wrote in this application. Results that still read it must be written first."""
    for path in _spilled.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def in_chunks(docs: DataFrame, chars: int = CHUNK_CHARS, least: int = 1_000_000) -> tuple[DataFrame, bool]:
    """(doc_id, text, times, chunk) and whether some times is over 1.

    As many chunks as keep each near `chars` characters, so their number grows
    with the corpus; a small corpus is still dealt to all partitions, `least`
    characters each. The chunk follows from the row's content, so that every
    pass over the table deals rows alike. Equal rows that together are longer
    than a chunk become one row that counts `times`, by an aggregation that
    adds up ahead of its shuffle; there are no more such rows than chunks.
    """
    row = F.xxhash64("doc_id", "text")
    sizes = docs.select(row.alias("row"), F.length("text").alias("n")).groupBy("row").agg(F.sum("n").alias("n"), F.count("*").alias("times"))
    hot = sizes.where((F.col("n") > chars) & (F.col("times") > 1)).select("row")
    total, some = sizes.agg(F.sum("n"), F.count_if((F.col("n") > chars) & (F.col("times") > 1))).first()
    total = total or 0
    n = max(1, -(-total // chars), min(partitions(docs.sparkSession), total // least))
    docs = docs.select("doc_id", "text")
    if some:
        keyed = docs.withColumn("row", row)
        few = keyed.join(F.broadcast(hot), "row", "left_semi").groupBy("doc_id", "text").agg(F.count("*").alias("times"))
        docs = keyed.join(F.broadcast(hot), "row", "left_anti").select("doc_id", "text", F.lit(1).cast("bigint").alias("times")).unionByName(few)
    else:
        docs = docs.withColumn("times", F.lit(1).cast("bigint"))
    return docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")), bool(some)


def unfolded(df: DataFrame) -> DataFrame:
    """Every row as often as its column times says; without that column."""
    return df.withColumn("times", F.explode(F.sequence(F.lit(1).cast("bigint"), "times"))).drop("times")


def remainder(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def repeated(pairs: DataFrame, check: str | None = None) -> DataFrame:
    """(h, chunk) of every key met more than once over all rows of (h, chunk, many).

    `many` marks a row that stands for several places of its chunk; check names
    a second column that equal keys must share. Rows are dealt by h, sorted
    and compared with their neighbours in a stream, so that a key of any number
    of rows needs no more memory than a batch.
    """
    keys = ["h", *([check] if check else [])]

    def neighbours(batches):
        last = None  # key columns, chunk and many of a row that waits for the next one
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(len(keys) + 2)]
            if last is not None:
                cols = [np.concatenate([[x], c]).astype(c.dtype) for x, c in zip(last, cols, strict=True)]
            *k, c, m = cols
            m = m.astype(bool)
            same = np.logical_and.reduce([x[1:] == x[:-1] for x in k])
            hit = m.copy()
            hit[1:] |= same
            hit[:-1] |= same
            # the last row waits; marked if an equal one came before
            last = [*(x[-1] for x in k), c[-1], bool(hit[-1])]
            hit[-1] = False
            yield pa.RecordBatch.from_arrays([pa.array(k[0][hit], pa.int64()), pa.array(c[hit], pa.int32())], ["h", "chunk"])
        if last is not None and last[-1]:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[-2]], pa.int32())], ["h", "chunk"])

    dealt = pairs.select(*keys, "chunk", "many").repartition(partitions(pairs.sparkSession), "h").sortWithinPartitions(*keys)
    return dealt.mapInArrow(neighbours, "h long, chunk int")


def sampled(rows: DataFrame, by: str, totals: dict, most: int, chars: int, seed: str) -> DataFrame:
    """(doc_id, row, <by>) of at most `most` distinct rows for each value of a column in totals (value: rows of it), and of at most so many characters together.

    rows: (doc_id, row, n, <by>), row being a hash of the text and n its
    length. Equal rows count once, those of the least hashes come first, and a
    text longer than an eighth of the characters is passed over. Hashes beyond
    what `most` rows of a value need are left out ahead of any shuffle.
    """
    spark, low, top = rows.sparkSession, -(1 << 63), (1 << 63) - 1
    below = [(k, min(top, low + int((1.3 * most + 200) / n * 2.0**64))) for k, n in totals.items() if n]
    limit = spark.createDataFrame(below, StructType([rows.schema[by], StructField("below", LongType())]))  # a row for each value
    marked = rows.withColumn("mark", F.xxhash64(F.lit(seed), "doc_id", "row")).join(F.broadcast(limit), by).where((F.col("mark") <= F.col("below")) & (F.col("n") <= chars // 8))
    few = marked.groupBy("doc_id", "row").agg(F.min(by).alias(by), F.min("n").alias("n"), F.min("mark").alias("mark"))
    w = Window.partitionBy(by).orderBy("mark", "doc_id", "row")
    first = few.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return first.withColumn("sum", F.sum("n").over(w)).where(F.col("sum") <= chars).select("doc_id", "row", by)


def one_text_each(docs: DataFrame, chosen: DataFrame, by: str) -> DataFrame:
    """(row, doc_id, text, <by>) of the rows that `sampled` chose, each once."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("row"))
    same = F.expr("doc_id <=> doc_id_ AND row = row_")
    held = F.broadcast(chosen.select(F.col("doc_id").alias("doc_id_"), F.col("row").alias("row_"), by))  # bounded by its parameters
    return keyed.join(held, same).groupBy("row", "doc_id").agg(F.first("text").alias("text"), F.first(by).alias(by))
