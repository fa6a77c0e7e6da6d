"""One query for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, quality_rules, resampling, url_filters
from .common import documents, table
from .context_mixing import language_scores
from .language_id import identify
from .packing import pack_documents
from .periodic_runs import run_digests
from .pii import replace_pii, surrogate_key
from .quality_classifier import quality_scores
from .quality_rules import quality_verdicts
from .sharding import shard_documents
from .simhash import near_duplicates
from .token_files import token_file_digest
from .tokens import default_vocabulary


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), default_vocabulary())


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(documents(spark, sf_dir), surrogate_key(spark)).select("doc_id", "text", "n_entities", "kinds")


def op3_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digest(documents(spark, sf_dir), default_vocabulary())


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op5_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op6_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))


def op7_url_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages"))


def op8_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(documents(spark, sf_dir)).drop("uid")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op12_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(documents(spark, sf_dir))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(documents(spark, sf_dir))


OPERATORS = (
    op1_best_fit_packing,
    op2_pii_surrogates,
    op3_simple8b_tokens,
    op4_simhash_near_dedup,
    op5_winnowing_decontamination,
    op6_vector_sharding,
    op7_url_automaton,
    op8_hyperdimensional_language,
    op9_quality_rules,
    op10_quality_classifier,
    op11_importance_resampling,
    op12_context_mixing,
    op13_periodic_runs,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_winnowing_decontamination": decontamination.ORACLE_SQL,
        "op7_url_automaton": url_filters.oracle_sql(),
        "op9_quality_rules": quality_rules.ORACLE_SQL,
        "op11_importance_resampling": resampling.ORACLE_SQL,
    }
