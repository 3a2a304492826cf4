"""Every registered query of the subpackage over whole small tables: columns, types, folds, rows; and all SQL against its query."""

import math
import os
import zlib

import duckdb
import pytest

from kmerloom.llm import registry

#: The columns that each query's contract names; others may follow.
COLUMNS = {
    "op1_spaced_seed_decontamination": {"doc_id": "bigint", "item_id": "bigint", "n_hits": "bigint"},
    "op2_simhash_trie": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op3_class_exchange_lm": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op4_difference_cover_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op5_ftrl_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op6_dice_licenses": {"doc_id": "bigint", "license": "string", "dice": "double"},
    "op7_feistel_pseudonyms": {"doc_id": "bigint", "text": "string", "n_replaced": "bigint"},
    "op8_counterfactual_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9_norm_sorted_products": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op10_sum_of_squares_packing": dict.fromkeys(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), "bigint"),
}
FOLDS = {"op3_class_exchange_lm": 10, "op5_ftrl_language": 5, "op8_counterfactual_toxicity": 5}
ONE_ROW_EACH = ("op2_simhash_trie", "op3_class_exchange_lm", "op4_difference_cover_dedup", "op5_ftrl_language", "op7_feistel_pseudonyms", "op8_counterfactual_toxicity")


@pytest.fixture(scope="module")
def tables(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def test_all_ten():
    assert set(registry.QUERIES) == set(COLUMNS) and set(registry.ORACLE_SQL) <= set(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, sf_dir, tables, name):
    df = registry.QUERIES[name](spark, sf_dir)
    types = dict(df.dtypes)
    assert {c: types.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = df.collect()
    ids = [r[0] for r in tables.execute("SELECT doc_id FROM documents").fetchall()]
    if name in ONE_ROW_EACH:
        assert sorted(r["doc_id"] for r in rows) == sorted(ids)
    if name in FOLDS:
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % FOLDS[name] == 0) for r in rows)
    if name in ("op5_ftrl_language", "op8_counterfactual_toxicity"):
        assert all(0 <= r["score"] <= 1 for r in rows)
    if name == "op8_counterfactual_toxicity":
        assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)
    if name == "op5_ftrl_language":
        known = {r[0] for r in tables.execute("SELECT DISTINCT lang FROM documents").fetchall()}
        assert {r["lang_pred"] for r in rows} <= known | {"und"}
    if name == "op3_class_exchange_lm":
        assert all(math.isfinite(r["score"]) for r in rows) and len({r["train_tokens"] for r in rows}) == 1
    if name in registry.ORACLE_SQL:
        got = tables.execute(registry.ORACLE_SQL[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted((tuple(r[c] for c in names) for r in rows), key=str) == sorted(got.fetchall(), key=str)
