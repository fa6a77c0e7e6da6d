"""Corpus preparation: quality rules, near-duplicates, benchmark passages, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shopledger.llm import decontamination, near_copies, packing, pii, quality_rules
from shopledger.llm.common import importable, materialise, table
from shopledger.llm.tokens import default_vocabulary


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject."""
    importable(spark)
    return quality_rules.keep_good(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are near-copies of one that stays."""
    importable(spark)
    return near_copies.drop_near_duplicates(docs)


def uncontaminated_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark passage."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def private_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates."""
    importable(spark)
    return pii.replace_pii(docs, pii.surrogate_key(spark), counts=False)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 2048 tokens."""
    importable(spark)
    return packing.pack_documents(docs, default_vocabulary())


STAGES = [
    ("quality rules", good_documents),
    ("simhash near-dedup", distinct_documents),
    ("benchmark decontamination", uncontaminated_documents),
    ("pii surrogates", private_documents),
    ("best-fit packing", packed_sequences),
]
#: Hashing, surrogates and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
