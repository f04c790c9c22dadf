"""Queries of the corpus operators over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.llm import bpe, brown, chat, decontam, hostrules, interactions, language, licenses, pii, quality, simhash, toxicity, trie
from lumen.llm.shared import documents


def tokenizer_path() -> str:
    """The tokenizer file that the queries use; LUMEN_TOKENIZER names another."""
    import public_tokenizers

    return os.environ.get("LUMEN_TOKENIZER") or public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "labels"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir, "doc_id", "text"), tokenizer_path())


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = hostrules.judge(documents(spark, sf_dir, "doc_id", "source", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(documents(spark, sf_dir, "doc_id", "text"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir, "doc_id", "text"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(documents(spark, sf_dir, "doc_id", "text"))


def op11_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(documents(spark, sf_dir, "doc_id", "text", "source"), table(spark, sf_dir, "labels"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(table(spark, sf_dir, "conversations"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir, "doc_id", "text", "lang")).drop("lang_spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality, op2_simhash, op3_toxicity, op4_bpe, op5_chat, op6_host_rules, op7_class_lm, op8_licenses, op9_decontamination, op10_pii, op11_interactions, op12_prefix_trie, op13_language)
}
ORACLES: dict[str, str] = {"op5_chat": chat.RENDER_SQL, "op6_host_rules": hostrules.judge_sql(), "op8_licenses": licenses.scan_sql(), "op11_interactions": interactions.AUDIT_SQL, "op12_prefix_trie": trie.TRIE_SQL}
