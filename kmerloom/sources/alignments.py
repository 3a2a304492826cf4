"""Reads of BAM files, and filters on alignments.

A BAM file is a series of gzip blocks; records are parsed from the stream of
one file, files are read in parallel.
"""

from __future__ import annotations

import gzip
import io
import struct
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The base of each 4-bit code of the format.
BASES = "=ACMGRSVTWYHKDBN"

#: Records handed on together.
BATCH = 50_000

SCHEMA = "path string, read_id string, flag int, ref string, seq string"


def keep_alignments(reads: DataFrame, require: int = 0, exclude: int = 0, without_refs: list[str] | str = ()) -> DataFrame:
    """Reads with all bits of `require`, none of `exclude`, and not mapped to a listed reference (a list, or names split by commas). A null ref is kept."""
    refs = [x.strip() for x in without_refs.split(",") if x.strip()] if isinstance(without_refs, str) else list(without_refs)
    out = reads.where((F.col("flag").bitwiseAND(require) == require) & (F.col("flag").bitwiseAND(exclude) == 0))
    return out.where(~F.coalesce(F.col("ref").isin(refs), F.lit(False))) if refs else out


def parse_bam(data: bytes):
    """(name, flag, ref or None, sequence) of each record of a BAM file."""
    f = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)))
    if f.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    f.read(struct.unpack("<i", f.read(4))[0])
    refs = []
    for _ in range(struct.unpack("<i", f.read(4))[0]):
        refs.append(f.read(struct.unpack("<i", f.read(4))[0])[:-1].decode())
        f.read(4)
    while head := f.read(4):
        block = f.read(struct.unpack("<i", head)[0])
        ref_id, _, l_name, _, _, n_cigar, flag, l_seq = struct.unpack_from("<iiBBHHHi", block)
        name = block[32 : 32 + l_name - 1].decode()
        at = 32 + l_name + 4 * n_cigar
        packed = block[at : at + (l_seq + 1) // 2]
        seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:l_seq]
        yield name, flag, refs[ref_id] if ref_id >= 0 else None, seq


def read_bam(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, read_id, flag, ref, seq) of BAM files; a file is read by one task."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                records = parse_bam(data)
                while rows := [(path, *r) for r in islice(records, BATCH)]:
                    yield pd.DataFrame(rows, columns=["path", "read_id", "flag", "ref", "seq"])

    return spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("path"), "content").mapInPandas(run, SCHEMA)
