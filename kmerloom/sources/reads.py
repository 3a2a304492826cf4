"""FASTA, FASTQ and BAM reads, plain or gzipped, and sample sheets.

Records are split by Spark's text source with a record separator, so plain
files are read in parallel pieces and gzipped ones file by file.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignments import keep_alignments, read_bam

#: Characters that a sample sheet's line can't hold.
FORBIDDEN = "<>{},[]"
FASTQ_NAME = re.compile(r"\.(fastq|fq)(\.gz)?$", re.IGNORECASE)


def _fasta(pieces: DataFrame, *keep: str) -> DataFrame:
    records = pieces.select(*keep, F.split(F.regexp_replace(F.regexp_replace("value", r"^>", ""), "\r", ""), "\n", 2).alias("r"))
    out = records.select(*keep, F.substring_index(F.col("r")[0], " ", 1).alias("read_id"), F.regexp_replace(F.coalesce(F.get("r", F.lit(1)), F.lit("")), r"\s", "").alias("seq"))
    return out.where("seq <> ''")


def _fastq(pieces: DataFrame, *keep: str) -> DataFrame:
    # a piece of one line is the rest of a quality line that starts with @
    records = pieces.select(*keep, F.split(F.regexp_replace(F.regexp_replace("value", r"^@|\s+$", ""), "\r", ""), "\n").alias("r")).where(F.size("r") > 1)
    wrong = ~F.startswith(F.coalesce(F.get("r", F.lit(2)), F.lit("")), F.lit("+"))
    seq = F.when(wrong, F.raise_error(F.concat(F.lit("not a FASTQ record of four lines: "), F.substring(F.array_join("r", "|"), 1, 80)))).otherwise(F.get("r", F.lit(1)))
    return records.select(*keep, F.substring_index(F.get("r", F.lit(0)), " ", 1).alias("read_id"), seq.alias("seq")).where("seq <> ''")


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(read_id, seq) of FASTA files; sequences may span lines."""
    return _fasta(spark.read.option("lineSep", "\n>").text(paths))


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(read_id, seq) of FASTQ files of four lines a record, whatever stands behind the plus; other layouts are an error.

    Pieces start where a line starts with @: a record, or what a quality line
    that starts so leaves behind.
    """
    return _fastq(spark.read.option("lineSep", "\n@").text(paths))


def kind_of(path: str) -> str:
    return "bam" if path.lower().endswith(".bam") else "fastq" if FASTQ_NAME.search(path) else "fasta"


def _read_kinds(spark: SparkSession, paths: list[str], with_path: bool, alignment_filter: dict) -> DataFrame:
    """Reads of files of any kind, one scan for each kind."""
    keep = [F.col("_metadata.file_path").alias("path")] if with_path else []
    own = ["path"] if with_path else []
    parts = []
    for kind, mark, parse in (("fasta", "\n>", _fasta), ("fastq", "\n@", _fastq)):
        if some := [p for p in paths if kind_of(p) == kind]:
            parts.append(parse(spark.read.option("lineSep", mark).text(some).select(*keep, "value"), *own))
    if some := [p for p in paths if kind_of(p) == "bam"]:
        parts.append(keep_alignments(read_bam(spark, some), **alignment_filter).select(*own, "read_id", "seq").where("seq <> ''"))
    return reduce(DataFrame.unionByName, parts)


def read_sequences(spark: SparkSession, paths: list[str], **alignment_filter) -> DataFrame:
    """Reads of FASTA, FASTQ and BAM files, told apart by name. alignment_filter: see `keep_alignments`."""
    return _read_kinds(spark, paths, False, alignment_filter)


def _files(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(path, name in the metadata of its rows) of the files that a path, a pattern or a folder stands for."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for found in fs.globStatus(p) or []:
        files = fs.listStatus(found.getPath()) if found.isDirectory() else [found]
        out += [(x.getPath().toString(), re.sub("^file:/+", "file:/", x.getPath().toUri().toString())) for x in files]
    if not out:
        raise FileNotFoundError(path)
    return out


def parse_sheet(lines: list[str]) -> list[tuple[int, str, list[str], int]]:
    """(number, sample, paths, own hard minimum or 0) of lines `sample : path ; path ! minimum`, in order."""
    out, seen = [], set()
    for line in lines:
        if not line.strip():
            continue
        m = re.fullmatch(r"\s*([^:;!]+?)\s*:\s*([^:!]+?)\s*(?:!\s*(\d+)\s*)?", line)
        if not m or any(c in line for c in FORBIDDEN):
            raise ValueError(f"not a sample line: {line!r}")
        if m[1] in seen:
            raise ValueError(f"sample {m[1]!r} comes twice")
        seen.add(m[1])
        out.append((len(out), m[1], [p.strip() for p in m[2].split(";") if p.strip()], int(m[3] or 0)))
    return out


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """(sample_idx, sample, paths, min_abund); the order of lines is that of matrix columns."""
    lines = [r[0] for r in spark.read.option("wholetext", True).text(path).collect()]
    rows = parse_sheet("\n".join(lines).splitlines())
    return spark.createDataFrame(rows, "sample_idx int, sample string, paths array<string>, min_abund int")


def read_samples(spark: SparkSession, sheet: DataFrame, **alignment_filter) -> DataFrame:
    """(sample, read_id, seq) of all files of a sheet, in one scan for each kind of file. alignment_filter: see `keep_alignments`."""
    listed = [(r["sample"], *f) for r in sheet.orderBy("sample_idx").collect() for p in r["paths"] for f in _files(spark, p)]
    owner = spark.createDataFrame([(s, name) for s, _, name in listed], "sample string, path string")  # a row for each file of the sheet
    found = _read_kinds(spark, sorted({path for _, path, _ in listed}), True, alignment_filter)
    return found.join(F.broadcast(owner), "path").select("sample", "read_id", "seq")


def read_thresholds(spark: SparkSession, path: str, n: int) -> list[int]:
    """One number a line, as many as samples."""
    values = [int(x) for r in spark.read.option("wholetext", True).text(path).collect() for x in r[0].split()]
    if len(values) != n:
        raise ValueError(f"{len(values)} thresholds for {n} samples")
    return values
