"""From raw documents to token ids: quality rules, near-duplicates, repeated passages, benchmark leaks, encoding.

Each stage takes (spark, documents, folder of the tables) and returns a DataFrame, which is written and read again before the
next one. A row's doc_id is its document: rows that repeat it fall together in the second stage; rows without one pass the
second and third stage as they are. An empty table passes all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bartide.llm import bytebpe, leaks, near, quality, units
from bartide.llm.common import columns_of, documents, free_name, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the risk-controlled ones."""
    return quality.kept_documents(docs, documents(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near-duplicates."""
    kept = near.near_classes(docs.where("doc_id is not null")).where("kept").select("doc_id").distinct()
    chosen = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return chosen.select(columns_of(docs)).unionByName(docs.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; documents of which no word is left go, those that had none before stay."""
    before = free_name(docs, "length")
    left = docs.withColumn(before, F.coalesce(F.length("text"), F.lit(0)))
    left = stored(units.without_spans(left, stored(units.repeated_passages(docs, units.SENTENCE_WORDS, units.SENTENCES))))
    left = units.without_spans(left, stored(units.repeated_windows(left)))
    left = left.where(F.col("text").rlike(r"[^\x20\x09-\x0D]") | (F.col(before) == F.coalesce(F.length("text"), F.lit(0))))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast("long"))
    return left.select(columns_of(docs))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return leaks.without_leaks(docs, documents(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and decoded bytes of what is left."""
    return bytebpe.encoded(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_leaks", benchmark_leaks), ("byte_bpe", byte_bpe)]
#: the second stage looks for similar texts by random signatures, which SQL can't express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over all documents."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
