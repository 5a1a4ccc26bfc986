"""Every registered text query over the smallest tables, with its SQL where there is one."""

from __future__ import annotations

import os

import duckdb
import pytest

import corpus_pipeline
from bartide.llm import queries

FOLDER = "/root/testdata/sf0.001"
NEEDED = {
    "op1": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}, "op2": {"doc_id", "class_id"},
    "op3": {"doc_id", "n_bytes", "n_tokens", "over_limit"}, "op4": {"doc_id", "item_id"}, "op5": {"doc_id", "held_out", "score", "predicted"},
    "op6": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}, "op7": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op8": {"doc_id", "start", "end"}, "op9": {"prompt", "chosen", "rejected"}, "op10": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op11": {"doc_id", "held_out", "lang_pred", "score"}, "op12": {"conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"},
    "op13": {"doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"}}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, name):
    frame = queries.QUERIES[name](spark, FOLDER)
    rows = frame.collect()
    assert NEEDED[name.split("_")[0]] <= set(frame.columns)
    if name.split("_")[0] not in ("op4", "op8", "op9", "op12"):
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect())
    if name in queries.SQL:
        db = duckdb.connect()
        for table in ("documents", "labels", "conversations", "benchmark"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
        columns = ", ".join(f'"{c}"' for c in frame.columns)
        assert sorted(map(repr, db.execute(f"SELECT {columns} FROM ({queries.SQL[name]})").fetchall())) == sorted(repr(tuple(r)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_pipeline_runs(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "benchmark_leaks", "byte_bpe"]
    assert 0 < corpus_pipeline.run(spark, FOLDER).count() < 200
