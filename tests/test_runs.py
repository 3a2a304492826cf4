"""Whole runs over two small samples with known results, and commands over their folders."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerloom.functions import dna, hashing
from kmerloom.operators import counting, merging, partitioning
from kmerloom.plans import commands, pipeline
from kmerloom.sources import kff, reads, store

from .test_sources import bam

# Reads of two samples, whose ids are equal, and the slots of one partition of each (k 31, window 25,000,000).
D1 = (
    "ACGACGACGACGAGACGAGACGACAGCAGACAGAGACATAATATACTATATAATATATATAGCGAGGGGGGGAGAGCCAGCAGCACCCCCAAAAAAAAA",
    "AGGCGCGTTTGTGTCGCCGCGGCGCCTGCTCTTCTATATATAAAACGACGACCGCAACACGACGCCAGCAGAGAGACGCACACGAGACAGCGACGAGCG",
)
D2 = (
    "AGAGGAAGGAATATTATATCTACTACCATCATCATCACTACTATCATACATACAGAGACAGCAGCAGAGCAGCACAAACGAGACACAAAAAAAGAGAGA",
    "ACGACACTATATATTTTATATATTATATCTTCCTCTCTTCGGGGGGGGGGGGGGGAAAAAAAAAAAAAAAAAAAACGCGGCGAAAAAAAAAAAAAAAAA",
)
SLOTS1 = """155248 2023705 2567452 3271445 3722264 3868850 3981633 4503227 4962163 6435533 6862965 6978078 6979593 7059918 7083145 7093738 7725591 9582574
10836088 12171240 12224316 13314627 14513366 14877205 15672741 16842616 16978940 17200308 18924300 20011491 20323485 22465575 22637986 22862427 22918283 23401230 24946865"""
SLOTS2 = """1303048 2821956 3573446 4954576 5940341 5964929 8761973 12178217 13532002 16524943 18299923 18309679 18709087 20543310 20906898 21688335 22116393 23796973
24160588 24544513"""


@pytest.fixture(scope="module")
def sheet(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("reads")
    lines = []
    for name, rows in (("D1", D1), ("D2", D2)):
        (folder / f"{name}.fasta").write_text("".join(f">{i}\n{q}\n" for i, q in enumerate(rows, 1)))
        lines.append(f"{name}: {folder}/{name}.fasta")
    (folder / "sheet").write_text("\n".join(lines) + "\n")
    return reads.read_sheet(spark, str(folder / "sheet"))


def test_known_counts(spark, sheet):
    found = reads.read_samples(spark, sheet)
    counts = counting.count_kmers(found, 31)
    assert {r["sample"]: (r["n"], r["most"]) for r in counts.groupBy("sample").agg(F.count("*").alias("n"), F.max("cnt").alias("most")).collect()} == {"D1": (138, 1), "D2": (138, 1)}
    assert merging.merge_counts(counts, ["D1", "D2"]).count() == 276
    slots = {(r["sample"], r["slot"]) for r in counts.select("sample", hashing.kmer_hash(F.col("kmer"), 25_000_000).alias("slot")).collect()}
    assert {(s, int(x)) for s, listed in (("D1", SLOTS1), ("D2", SLOTS2)) for x in listed.split()} <= slots


def test_super_kmers_keep_reads_of_equal_names_apart(spark, sheet):
    found = reads.read_samples(spark, sheet)
    assert sorted(r["read_id"] for r in found.collect()) == ["1", "1", "2", "2"]
    got = partitioning.super_kmers(found, 31, 10).collect()
    texts = dict(zip([("D1", "1"), ("D1", "2"), ("D2", "1"), ("D2", "2")], D1 + D2, strict=True))
    assert len(got) < 60 and sum(r["n_kmers"] for r in got) == 276
    listed = [(r["sample"], texts[r["sample"], r["read_id"]][r["start"] + j : r["start"] + j + 31], r["minimizer"]) for r in got for j in range(r["n_kmers"])]
    kmers = spark.createDataFrame([(s, x) for s, x, _ in listed], "sample string, kmer string").select("sample", dna.canonical_digits(dna.digits(F.col("kmer"))).alias("kmer"))
    want = sorted((r["sample"], r["kmer"], r["minimizer"]) for r in partitioning.with_minimizer(counting.explode_kmers(found, 31, "sample").select("sample", "kmer"), 31, 10).collect())
    assert sorted((r["sample"], r["kmer"], v) for r, (_, _, v) in zip(kmers.collect(), listed, strict=True)) == want
    assert "Exchange" not in partitioning.super_kmers(found, 31, 10)._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")


def test_super_kmers_of_odd_reads(spark):
    rows = [("a", None), ("a", ""), ("b", "NN" + D1[0][:40] + "NxN" + D1[0][40:]), ("a", "ACGT"), ("b", D2[1].lower())]
    df = spark.createDataFrame(rows, "sample string, seq string").coalesce(1)
    got = partitioning.super_kmers(df, 21, 8).collect()
    assert {(r["sample"], r["run"]) for r in got} == {("b", 0), ("b", 1), ("b", 2)}  # the first piece of a read that starts with N is empty
    assert sum(r["n_kmers"] for r in got if r["run"] == 1) == 20 and sum(r["n_kmers"] for r in got if r["run"] == 0) == 79
    codes = np.array([("ACTG".index(c) if c in "ACTG" else 4) for c in D1[0] + "N" + D2[0]], np.uint8)
    whole = [np.concatenate(x) for x in zip(*partitioning.minimizer_runs(codes, 21, 8), strict=True)]
    for block in (3, 64):
        assert all((np.concatenate(x) == y).all() for x, y in zip(zip(*partitioning.minimizer_runs(codes, 21, 8, block=block), strict=True), whole, strict=True))


@pytest.mark.parametrize("plus", ["+", "+q{i} x"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fastq_layouts(spark, tmp_path, plus, end):
    records = [("ACGTAC", "@IIIII"), ("TTTTT", "+@III"), ("GG", "@@"), ("CCC", "@+I")]
    lines = [x for i, (q, s) in enumerate(records) for x in (f"@q{i} x", q, plus.format(i=i), s)]
    (tmp_path / "a.fq").write_bytes((end.join(lines) + end).encode())
    got = sorted(map(tuple, reads.read_fastq(spark, str(tmp_path / "a.fq")).collect()))
    assert got == [(f"q{i}", q) for i, (q, _) in enumerate(records)]


def test_what_is_not_fastq_is_an_error(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@q1\nACGT\nACGT\n+\nIIIIIIII\n")
    with pytest.raises(Exception, match="not a FASTQ record"):
        reads.read_fastq(spark, str(tmp_path / "a.fastq")).collect()


def test_bam_in_a_sheet(spark, tmp_path):
    import gzip

    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "x.bam").write_bytes(gzip.compress(bam([("r1", 0, 0, "ACGTN"), ("r2", 4, -1, "GGGT"), ("r3", 5, -1, "TTTT")])))
    (tmp_path / "y.fa").write_text(">r4\nCCCC\n")
    sheet = spark.createDataFrame([(0, "s", [str(tmp_path / "a b" / "x.bam"), str(tmp_path / "*.fa")], 0)], "sample_idx int, sample string, paths array<string>, min_abund int")
    ids = lambda **o: sorted(r["read_id"] for r in reads.read_samples(spark, sheet, **o).collect())
    assert ids() == ["r1", "r2", "r3", "r4"]
    assert ids(require=4, exclude=1) == ["r2", "r4"] and ids(without_refs="chr1") == ["r2", "r3", "r4"]
    run = pipeline.run_sheet(spark, sheet, str(tmp_path / "run"), pipeline.Options(k=8, m=4, hard_min=1, until="superk", require=4))
    assert run.kind("superk") == "super_kmers"
    with pytest.raises(FileNotFoundError):
        reads.read_samples(spark, sheet.withColumn("paths", F.array(F.lit(str(tmp_path / "none.fa")))))


def test_run_counts_once_and_leaves_nothing_behind(spark, sheet, tmp_path):
    o = pipeline.Options(hard_min=1, histogram=True, bounds=(2, 10), soft_min=0.5, restrict_share=0.5, partitions=0)
    run = pipeline.run_sheet(spark, sheet, str(tmp_path / "r"), o)
    meta = run.meta()
    assert meta["partitions"] == 4 and len(meta["restricted_to"]) == 2 and run.meta("merge")["soft_min"] == [1, 1] and run.meta("info")["seconds"] > 0
    assert {r["part"] for r in run.load("counts").select("part").distinct().collect()} <= set(meta["restricted_to"])
    n = run.load("counts").where("sample = 'D1'").count()
    assert run.histogram_lines("D1") == ["@LOWER=2", "@UPPER=10", f"@OOB_L={n}", "@OOB_U=0", *(f"{a} 0" for a in range(2, 11))]
    for name in ("unfiltered", "merged"):
        with pytest.raises(Exception):
            run.load(name)
    again = pipeline.run_sheet(spark, sheet, str(tmp_path / "again"), pipeline.Options(hard_min=1, until="repart", partitions=0), repart_from=run.path)
    assert again.load("repartition").select("part").distinct().count() == meta["partitions"]
    with pytest.raises(ValueError):
        pipeline.settle(spark, reads.read_samples(spark, sheet), pipeline.Options(k=21), run.path)


def test_kff_of_a_run(spark, sheet, tmp_path):
    run = pipeline.run_sheet(spark, sheet, str(tmp_path / "r"), pipeline.Options(hard_min=1, until="count", kff=True))
    assert kff.write_files(run.load("kff"), str(tmp_path / "files")) > 0
    got = sorted(map(tuple, kff.read_kff(spark, str(tmp_path / "files")).collect()))
    assert got == sorted(map(tuple, run.load("counts").select(dna.letters(F.col("kmer")), "cnt").collect())) and len(got) == 276
    for bad in ({"kff": True}, {"vectors": True}, {"restrict_share": 0.5, "restrict_to": [1]}):
        with pytest.raises(ValueError):
            pipeline.Options(**bad)


def test_bit_vectors(spark, sheet, tmp_path):
    from kmerloom.operators import reshaping

    o = pipeline.Options(hard_min=1, mode="hash:bft:bin", vectors=True, bloom_size=2000)
    run = pipeline.run_sheet(spark, sheet, str(tmp_path / "r"), o)
    want = sorted(map(tuple, run.load("counts").select("sample", "slot").collect()))
    for name in ("vectors", "matrix"):
        assert run.kind(name) == "bit_vectors"
        assert sorted(map(tuple, reshaping.vector_slots(run.load(name), o.window).collect())) == want


@pytest.mark.parametrize("mode", ["kmer:count:bin", "hash:count:bin", "kmer:pa:bin"])
def test_commands(spark, tmp_path, mode):
    q = [x + y for x, y in zip(D1, D2, strict=True)]
    rows = {"a": [q[0]], "b": [q[0][50:], q[1]], "c": [q[1][:90], q[0][20:]]}
    of = lambda names: spark.createDataFrame([(s, x) for s in names for x in rows[s]], "sample string, seq string")
    listed = lambda names: spark.createDataFrame([(i, s, ["-"], 0) for i, s in enumerate(names)], "sample_idx int, sample string, paths array<string>, min_abund int")
    o = pipeline.Options(k=21, m=8, hard_min=1, mode=mode, bloom_size=4000)
    make = lambda names, folder: pipeline.run(spark, of(names), listed(names), str(tmp_path / folder), o)
    key = "slot" if mode.startswith("hash") else "kmer"
    table = lambda df: {r[key]: tuple(r["counts"]) for r in df.collect()}
    all_, ab, c = make("abc", "all"), make("ab", "ab"), make("c", "c")
    assert table(commands.combine_runs([ab, c], str(tmp_path / "both")).load("matrix")) == table(all_.load("matrix"))
    filtered = commands.filter_run(ab, of("c"), listed("c"), str(tmp_path / "filtered"))
    own, other = table(ab.load("matrix")), table(c.load("matrix"))
    presence = ":pa:" in mode
    assert table(filtered.load("matrix")) == {x: n if presence else n + other[x] for x, n in own.items() if x in other}
    assert table(filtered.load("vector")) == {x: other.get(x, (0,)) for x in own}
    assert {r[key] for r in filtered.load("key").collect()} == set(other) - set(own)
    assert filtered.meta()["samples"] == (["a", "b"] if presence else ["a", "b", "c"]) and filtered.dump("matrix").count() == len(table(filtered.load("matrix")))
    keys = [r[key] for r in commands.aggregate_run(all_, ordered=True, count=False).collect()]
    assert keys == sorted(table(all_.load("matrix")))
    assert sum(r["n_kmers"] for r in commands.partition_info(all_).collect()) == all_.load("counts").count()
    with pytest.raises(ValueError):
        commands.filter_run(ab, of("bc"), listed("bc"), str(tmp_path / "two"))
    with pytest.raises(ValueError):
        commands.combine_runs([ab, pipeline.run(spark, of("c"), listed("c"), str(tmp_path / "other"), pipeline.Options(k=22, m=8, hard_min=1, mode=mode, bloom_size=4000))], str(tmp_path / "no"))


def test_counts_only_runs_are_combined(spark, sheet, tmp_path):
    o = pipeline.Options(hard_min=1, until="count")
    run = pipeline.run_sheet(spark, sheet, str(tmp_path / "r"), o)
    both = commands.combine_runs([run, run], str(tmp_path / "both"))
    assert both.meta()["samples"] == ["D1", "D2", "D1_1", "D2_1"]
    assert {tuple(r["counts"]) for r in both.load("matrix").collect()} == {(1, 0, 1, 0), (0, 1, 0, 1)}


def test_a_thousand_samples(spark):
    names = [f"s{i}" for i in range(1000)]
    counts = spark.range(60_000).select(F.concat(F.lit("s"), (F.col("id") % 1200).cast("string")).alias("sample"), (F.col("id") % 70).cast("string").alias("kmer")).groupBy("sample", "kmer").agg(F.count("*").alias("cnt"))
    want = {}
    for r in counts.collect():
        if r["sample"] in set(names):
            want.setdefault(r["kmer"], [0] * 1000)[int(r["sample"][1:])] = r["cnt"]
    got = {r["kmer"]: list(r["counts"]) for r in merging.merge_counts(counts, names).collect()}
    assert got == want


def test_format_of_stored_counts(tmp_path):
    data = kff.encode([("ACGTTGCAA", 3)], 9)
    assert struct.unpack_from(">I", data, 8)[0] == 0 and store.KINDS
