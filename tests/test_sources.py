import gzip
import struct

import pytest
from pyspark.sql import functions as F

from kmerloom.functions import dna
from kmerloom.operators import counting, merging
from kmerloom.plans import pipeline
from kmerloom.sources import alignments, kff, reads, store
from kmerloom.streaming import counts as streaming


def put(path, text, packed=False):
    (gzip.open if packed else open)(path, "wt").write(text)
    return str(path)


FASTA = ">r1 first\nACGTACGTACGTTT\nGGA\n>r2\r\nACGT\r\nNNAC\r\n>empty\n>r3\nTTTT"
FASTQ = "@q1 x\nACGTAC\n+\n@IIIII\n@q2\nTTTTT\n+\n+@III\n@q3\nGG\n+\nII\n"


@pytest.mark.parametrize("packed", [False, True])
def test_reads(spark, tmp_path, packed):
    end = ".gz" if packed else ""
    a, q = put(tmp_path / f"a.fa{end}", FASTA, packed), put(tmp_path / f"q.fastq{end}", FASTQ, packed)
    want = {("r1", "ACGTACGTACGTTTGGA"), ("r2", "ACGTNNAC"), ("r3", "TTTT"), ("q1", "ACGTAC"), ("q2", "TTTTT"), ("q3", "GG")}
    assert {tuple(r) for r in reads.read_sequences(spark, [a, q]).collect()} == want


def test_sheet(spark, tmp_path):
    a, b = put(tmp_path / "a.fa", ">x\nACGT\n"), put(tmp_path / "b.fa", ">y\nTTTT\n")
    p = put(tmp_path / "sheet", f"D1 : {a} ; {b} ! 20\n\nD2: {b}\n")
    sheet = reads.read_sheet(spark, p)
    assert [tuple(r) for r in sheet.orderBy("sample_idx").collect()] == [(0, "D1", [a, b], 20), (1, "D2", [b], 0)]
    assert sorted((r["sample"], r["seq"]) for r in reads.read_samples(spark, sheet).collect()) == [("D1", "ACGT"), ("D1", "TTTT"), ("D2", "TTTT")]
    assert {r["sample"]: r["least"] for r in counting.sample_min(sheet, 2).collect()} == {"D1": 20, "D2": 2}
    for bad in ("D1 : a\nD1 : b", "no colon", "x : a<b"):
        with pytest.raises(ValueError):
            reads.parse_sheet(bad.splitlines())
    t = put(tmp_path / "limits", "3\n4\n")
    assert reads.read_thresholds(spark, t, 2) == [3, 4]
    with pytest.raises(ValueError):
        reads.read_thresholds(spark, t, 3)


def bam(records):
    """An uncompressed BAM body with one reference."""
    out = [b"BAM\1", struct.pack("<i", 0), struct.pack("<i", 1), struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)]
    for name, flag, ref, seq in records:
        codes = [alignments.BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
        body = struct.pack("<iiBBHHHiiii", ref, 0, len(name) + 1, 0, 0, 0, flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + b"\xff" * len(seq)
        out.append(struct.pack("<i", len(body)) + body)
    return b"".join(out)


def test_bam(spark, tmp_path):
    rows = [("r1", 0, 0, "ACGTN"), ("r2", 4, -1, "GGGT"), ("r3", 5, -1, "T")]
    data = bam(rows)
    # two gzip members, as blocks of the format
    (tmp_path / "x.bam").write_bytes(gzip.compress(data[:60]) + gzip.compress(data[60:]))
    got = alignments.read_bam(spark, str(tmp_path / "x.bam"))
    assert [tuple(r)[1:] for r in got.orderBy("read_id").collect()] == [("r1", 0, "chr1", "ACGTN"), ("r2", 4, None, "GGGT"), ("r3", 5, None, "T")]
    ids = lambda df: sorted(r["read_id"] for r in df.collect())
    assert ids(alignments.keep_alignments(got, require=4)) == ["r2", "r3"]
    assert ids(alignments.keep_alignments(got, require=4, exclude=1)) == ["r2"]
    assert ids(alignments.keep_alignments(got, without_refs=" chr1 , chr2")) == ["r2", "r3"]


def test_kff(spark, tmp_path):
    rows = [("ACGTTGCAA", 3), ("TTTTTTTTT", 1 << 40), ("GGGGGGGGG", 0)]
    df = spark.createDataFrame(rows, "kmer string, cnt bigint").coalesce(1)
    got = kff.decode_files(kff.kff_files(df, 9, rows=2)).collect()
    assert sorted(map(tuple, got)) == sorted([("ACGTTGCAA", 3), ("TTTTTTTTT", (1 << 32) - 1), ("GGGGGGGGG", 0)])
    (tmp_path / "x.kff").write_bytes(kff.encode(rows, 9, 8))
    assert sorted(map(tuple, kff.read_kff(spark, str(tmp_path / "x.kff")).collect())) == sorted(rows)


@pytest.fixture(scope="module")
def small(spark):
    rows = [("a", "ACGTACGGTCAGTTACGATCCAGT" * 3), ("b", "ACGTACGGTCAGTTACGATTTTGT" * 2), ("a", "GGGTACGATCAGTCATTTACGGAC")]
    sheet = spark.createDataFrame([(0, "a", ["-"], 0), (1, "b", ["-"], 1)], "sample_idx int, sample string, paths array<string>, min_abund int")
    return spark.createDataFrame([(s, q, i) for i, (s, q) in enumerate(rows)], "sample string, seq string, read_id long"), sheet


@pytest.mark.parametrize("mode", pipeline.MODES)
def test_pipeline_modes(spark, small, tmp_path, mode):
    r, sheet = small
    o = pipeline.Options(k=11, m=5, mode=mode, hard_min=1, soft_min=2, share_min=1, bloom_size=2000, histogram=True)
    run = pipeline.run(spark, r, sheet, str(tmp_path / "run"), o)
    assert run.meta()["samples"] == ["a", "b"]
    counts = counting.count_kmers(r, 11)
    if mode.startswith("kmer"):
        want = merging.solidify(merging.merge_counts(counts, ["a", "b"]), 2, 2, share_min=1)
        expected = {x["kmer"]: list(x["counts"]) for x in want.collect()}
        if "pa" in mode:
            expected = {x: [int(v > 0) for v in c] for x, c in expected.items()}
        if mode.endswith("bin"):
            assert {x["kmer"]: list(x["counts"]) for x in run.load("matrix").collect()} == expected
            assert run.dump("matrix").count() == len(expected)
        else:
            lines = {x[0] for x in spark.read.text(f"{run.path}/matrix_text").collect()}
            assert lines == {" ".join([x.translate(str.maketrans("0123", "ACTG")), *map(str, c)]) for x, c in expected.items()}
    elif mode in ("hash:bf:bin", "hash:bfc:bin"):
        assert run.load("matrix").count() == o.window.slots
    assert run.load("merge_info").count() == 2 and run.load("histogram").count() > 0
    assert run.load("counts", [0]).where("part <> 0").count() == 0


def test_pipeline_stops_and_checks(spark, small, tmp_path):
    r, sheet = small
    run = pipeline.run(spark, r, sheet, str(tmp_path / "c"), pipeline.Options(k=11, m=5, hard_min=1, until="count", soft_min=0.5))
    assert run.kind("counts") == "kmer_counts" and run.dump("counts").count() > 0
    pipeline.run(spark, r, sheet, str(tmp_path / "s"), pipeline.Options(k=11, m=5, until="superk"))
    pipeline.run(spark, r, sheet, str(tmp_path / "r"), pipeline.Options(k=11, m=5, until="repart"))
    other = pipeline.run(spark, r, sheet, str(tmp_path / "d"), pipeline.Options(k=12, m=5, hard_min=1, soft_min=0.5, plugin=merging.all_at_least(1)))
    with pytest.raises(ValueError):
        run.check_same(other)
    for bad in ({"mode": "kmer:bf:bin"}, {"k": 5}, {"until": "never"}, {"mode": "hash:bf:bin", "restrict_to": [1]}):
        with pytest.raises(ValueError):
            pipeline.Options(**bad)
    part = pipeline.run(spark, r, sheet, str(tmp_path / "p"), pipeline.Options(k=11, m=5, hard_min=1, restrict_to=[2]))
    assert {x["part"] for x in part.load("counts").select("part").distinct().collect()} <= {2}


def test_streams(spark, small, tmp_path):
    r, _ = small
    path = str(tmp_path / "in")
    r.withColumn("ts", F.timestamp_seconds(F.col("read_id") * 600)).repartition(3).write.parquet(path)
    schema = "sample string, seq string, read_id long, ts timestamp"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    want = sorted(map(tuple, counting.count_kmers(r, 11).collect()))
    q = streaming.running_counts(stream(), 11).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("running").collect())) == want
    q = streaming.append_batches(stream(), 11, str(tmp_path / "out"), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, streaming.total_counts(spark, str(tmp_path / "out")).collect())) == want
    q = streaming.windowed_counts(stream(), 11, "10 minutes", "1 hour").writeStream.outputMode("append").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").columns == ["start", "sample", "kmer", "cnt"]


def test_api_is_whole():
    from kmerloom import api

    assert all(hasattr(api, name) for name in api.__all__)
    assert api.infos()["k"] == (8, 127)
