"""A corpus pipeline of five stages: each takes (spark, docs, sf_dir) and works on all that the one before kept.

1. toxicity: documents scored at 0.5 or more go; the model learns from labels of the documents it is given.
2. simhash_near_dedup: one document of each near-duplicate group stays: the SimHash trie's links, checked by the
   Jaccard similarity (0.8 or more) of five-word shingles, and those beyond its budget, found exactly.
3. decontamination: documents with a verified overlap with a benchmark item go.
4. pii: personal values become format-preserving pseudonyms; n_chars follows the text.
5. packing: the documents' tokens are placed in sequences of at most 1024.

Defined results: a null text is kept by stages 1 and 3 (as an empty one),
counts as a wordless one in 2, stays null in 4 and is one end token in 5; rows
that repeat one another are near-duplicates; further columns are kept up to
stage 4; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm import _util as U
from kmerloom.llm.decontamination import contaminated
from kmerloom.llm.packing import pack
from kmerloom.llm.pii import pseudonymise_text
from kmerloom.llm.simhash import representatives
from kmerloom.llm.toxicity import learn, score


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = learn(docs.select("doc_id", "text"), U.table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    own = f"toxicity_{uuid.uuid4().hex}"
    return score(docs, model, own).where(F.col(own) < 0.5).drop(own)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = f"row_{uuid.uuid4().hex}"
    row = F.xxhash64("doc_id", "text")
    hit = contaminated(docs.select(row.alias("doc_id"), "text"), U.table(spark, sf_dir, "benchmark"))
    return docs.withColumn(own, row).join(hit.select(F.col("doc_id").alias(own)).distinct(), own, "left_anti").select(docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pseudonymise_text(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("toxicity", toxicity), ("simhash_near_dedup", simhash_near_dedup), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]

#: Sorting out, linking and packing are not expressible in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = U.spread(U.table(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = U.spill(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
