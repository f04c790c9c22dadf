"""The corpus pipeline: toxic documents go, one document of each group of near copies stays, documents that hold benchmark
items go, personal data are replaced in the texts, and what is left is encoded as tokens.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept.

Defined results: rows are judged, not ids, so repeated and null ids are no matter except where said; a null text is an empty
one; other columns go through all but the last stage, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumen.llm import bpe, decontam, pii, simhash, toxicity
from lumen.llm.queries import table, tokenizer_path
from lumen.llm.shared import small_batches
from lumen.plans.durable import stored


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows and columns of docs that the toxicity model does not reject; without any toxic vote all stay."""
    small_batches(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows and columns of docs, of each group of similar texts the row with the smallest id; all empty texts are one group."""
    small_batches(spark)
    return simhash.without_near_duplicates(docs)


def remove_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows and columns of docs that hold no benchmark item; null and empty items are held by none."""
    small_batches(spark)
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows and columns of docs, with personal data and terms that disclose them replaced; a null text becomes empty."""
    small_batches(spark)
    return pii.sanitise(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids and the text that the ids decode to, for every row; the last stage, so all other columns end here."""
    small_batches(spark)
    return bpe.encode_and_decode(docs, tokenizer_path())


STAGES = [
    ("toxicity", remove_toxic),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", remove_benchmark_items),
    ("pii", replace_personal_data),
    ("bpe", encode_tokens),
]
#: The stages are classifiers, graph algorithms and a transducer; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; between stages the rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
