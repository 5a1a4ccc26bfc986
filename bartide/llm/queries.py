"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bartide.llm import bytebpe, chat, langid, lattice, leaks, merkle, near, quality, sharding, tokens, toxicity, trie, units
from bartide.llm.common import documents


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(documents(spark, folder), documents(spark, folder, "labels"))


def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_classes(documents(spark, folder))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_counts(documents(spark, folder))


def op4_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.contaminated(documents(spark, folder), documents(spark, folder, "benchmark"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, folder), documents(spark, folder, "labels"))


def op6_lattice_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.lm_scores(documents(spark, folder))


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bytebpe.encoded(documents(spark, folder), with_ids=False)


def op8_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return units.repeated_passages(documents(spark, folder))


def op9_chat_preferences(spark: SparkSession, folder: str) -> DataFrame:
    return chat.chat_preferences(documents(spark, folder, "conversations"))


def op10_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.sharded(documents(spark, folder))


def op11_language_ids(spark: SparkSession, folder: str) -> DataFrame:
    return langid.language_ids(documents(spark, folder))


def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.conversation_trie(documents(spark, folder, "conversations"))


def op13_dataset_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.dataset_manifest(documents(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_near_duplicates, op3_token_counts, op4_benchmark_leaks, op5_toxicity, op6_lattice_scores, op7_byte_bpe, op8_repeated_passages, op9_chat_preferences, op10_shards,
                                                                                   op11_language_ids, op12_conversation_trie, op13_dataset_manifest)}
SQL: dict[str, str] = {"op1_quality_rules": quality.SQL, "op8_repeated_passages": units.SQL, "op9_chat_preferences": chat.SQL, "op12_conversation_trie": trie.SQL,
                       "op13_dataset_manifest": merkle.SQL}
