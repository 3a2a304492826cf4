"""K-mer file format, version 1: raw sections of k-mers with counts."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the format: marks, version, codes of A, C, G, T.
MARK, VERSION = b"KFF", (1, 0)
ENCODING = 0b00_01_11_10
DIGIT = {"A": 0, "C": 1, "G": 3, "T": 2}


def encode(kmers: list[tuple[str, int]], k: int, data_size: int = 4) -> bytes:
    """A file of k-mers (letters) and counts, a block for each."""
    out = [MARK, bytes([*VERSION, ENCODING, 1, 1]), struct.pack(">I", 0)]
    names = {"k": k, "max": 1, "data_size": data_size}
    out += [b"v", struct.pack(">Q", len(names)), *(n.encode() + b"\0" + struct.pack(">Q", v) for n, v in names.items())]
    out += [b"r", struct.pack(">Q", len(kmers))]
    size, top = (2 * k + 7) // 8, (1 << 8 * data_size) - 1
    for kmer, n in kmers:
        x = 0
        for c in kmer:
            x = x << 2 | DIGIT[c]
        out += [x.to_bytes(size), min(n, top).to_bytes(data_size)]
    return b"".join([*out, MARK])


def decode(data: bytes):
    """(k-mer, count) of each block; blocks of several k-mers are taken apart."""
    if data[:3] != MARK or data[-3:] != MARK:
        raise ValueError("not a KFF file")
    code = data[5]
    letter = {code >> s & 3: c for s, c in zip((6, 4, 2, 0), "ACGT", strict=True)}
    at = 12 + struct.unpack_from(">I", data, 8)[0]
    var: dict[str, int] = {}
    while at < len(data) - 3:
        kind, n = data[at : at + 1], struct.unpack_from(">Q", data, at + 1)[0]
        at += 9
        if kind == b"v":
            for _ in range(n):
                end = data.index(b"\0", at)
                var[data[at:end].decode()] = struct.unpack_from(">Q", data, end + 1)[0]
                at = end + 9
        elif kind == b"r":
            k, most, size = var["k"], var["max"], var["data_size"]
            wide = 0 if most == 1 else (most.bit_length() + 7) // 8
            for _ in range(n):
                many = int.from_bytes(data[at : at + wide]) if wide else 1
                at += wide
                bases = k + many - 1
                packed = (2 * bases + 7) // 8
                x = int.from_bytes(data[at : at + packed])
                at += packed
                seq = "".join(letter[x >> 2 * (bases - 1 - j) & 3] for j in range(bases))
                for j in range(many):
                    yield seq[j : j + k], int.from_bytes(data[at : at + size]) if size else 0
                    at += size
        else:
            raise ValueError(f"unknown section {kind!r}")


def kff_files(counts: DataFrame, k: int, data_size: int = 4, rows: int = 200_000) -> DataFrame:
    """(content) of KFF files of (kmer, cnt) rows, so many k-mers each."""
    import pandas as pd

    def run(batches):
        held = []
        for pdf in batches:
            held += zip(pdf["kmer"], pdf["cnt"], strict=True)
            while len(held) >= rows:
                yield pd.DataFrame({"content": [encode(held[:rows], k, data_size)]})
                held = held[rows:]
        if held:
            yield pd.DataFrame({"content": [encode(held, k, data_size)]})

    return counts.select("kmer", "cnt").mapInPandas(run, "content binary")


def write_files(files: DataFrame, folder: str) -> int:
    """Writes (content) rows as numbered files to a folder that the driver reaches, one at a time; gives their number."""
    spark = files.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    n = 0
    for r in files.select("content").toLocalIterator():
        out = fs.create(path(f"{folder}/part-{n:05d}.kff"))
        out.write(bytearray(r["content"]))
        out.close()
        n += 1
    return n


def read_kff(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(kmer, cnt) of KFF files."""
    return decode_files(spark.read.format("binaryFile").load(paths).select("content"))


def decode_files(files: DataFrame) -> DataFrame:
    import pandas as pd

    def run(batches):
        for pdf in batches:
            for data in pdf["content"]:
                yield pd.DataFrame(list(decode(bytes(data))), columns=["kmer", "cnt"])

    return files.mapInPandas(run, "kmer string, cnt bigint")
