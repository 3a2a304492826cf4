import pytest
from pyspark.sql import functions as F

from . import helpers as H

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with a case for each stage."""
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, H.prose(30, i, 3000)) for i in range(120)]
    rows = [(i, t + (" vilething grubble" if i % 3 == 0 else "")) for i, t in rows]
    item = H.prose(40, 999, 5000)
    rows += [(500, H.prose(30, 500, 3000)), (501, H.prose(30, 500, 3000)), (502, H.prose(20, 7, 5000) + " " + item), (503, "write to jo.doe7@mail2.example.com now, " + H.prose(30, 503, 3000)), (504, None), (505, "")]
    H.documents(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows


def test_stages(spark, folder):
    d, rows = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept, n = {}, len(rows)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.dtypes == docs.dtypes
        docs = pipeline.U.spill(out, name)
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert len(kept[name]) == docs.count() <= n
        n = len(kept[name])
    toxic = {i for i, t in rows if t and "vilething" in t}
    assert set(kept["toxicity"]) == {i for i, _ in rows} - toxic
    assert set(kept["toxicity"]) - set(kept["simhash_near_dedup"]) == {501, 505}
    assert set(kept["simhash_near_dedup"]) - set(kept["decontamination"]) == {502}
    changed = {i for i in kept["pii"] if kept["pii"][i] != kept["decontamination"][i]}
    assert changed == {503} and "jo.doe7" not in kept["pii"][503]
    packed = pipeline.STAGES[-1][1](spark, docs, d)
    assert {r["doc_id"] for r in packed.collect()} == set(kept["pii"])
    assert sorted(map(tuple, pipeline.run(spark, d).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, packed.select("doc_id", "start", "length", "ids_crc32").collect()))


def test_columns_with_names_that_stages_use(spark, folder):
    """Extra columns come through all stages but the last, whatever their names; with nulls, copies and rows without doc_id."""
    d, rows = folder
    plain = spark.read.parquet(f"{d}/documents.parquet")
    docs = H.documents(spark, [*rows, (None, None), (None, "only words here"), (None, "only words here")], extra=True)
    for name in ("root", "set", "a", "b", "chunk", "times", "item", "q", "span", "own", "mark", "toxic"):
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(name))
    for name, stage in pipeline.STAGES[:-1]:
        want = {r["doc_id"] for r in stage(spark, plain, d).collect()}
        out = stage(spark, docs, d)
        assert out.dtypes == docs.dtypes
        out = out.collect()
        assert {r["doc_id"] for r in out} - {None} == want and all(r["root"] == "root" and r["h"] == 7 for r in out)
        assert any(r["doc_id"] is None for r in out)
        plain, docs = pipeline.U.spill(stage(spark, plain, d), name), pipeline.U.spill(stage(spark, docs, d), name)
    assert {r["doc_id"] for r in pipeline.STAGES[-1][1](spark, docs, d).collect()} - {None} == want


def test_empty_table(spark, folder):
    d, _ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet").where("false")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, d).count() == 0
