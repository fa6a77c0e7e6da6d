"""Audits: row rules, keys, references, validity windows, strict lookups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class UnknownValues(ValueError):
    """Values that the vocabulary does not hold."""


def check_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations of each rule in one pass; a rule that is null passes, as in SQL."""
    counted = df.agg(*[F.count(F.when(~rule, 1)).alias(name) for name, rule in rules.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"`{name}`").alias("violations")) for name in rules])
    return counted.select(F.inline(pairs))


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; a key with a null is unlike any other."""
    known = df
    for k in keys:
        known = known.filter(F.col(k).isNotNull())
    return known.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows of ``child`` that point to no row of ``parent``; a null points nowhere and passes."""
    known = parent.select(F.col(parent_key or key).alias("_k")).distinct()
    return child.filter(F.col(key).isNotNull()).join(known, child[key] == known["_k"], "left_anti")


def require_known(df: DataFrame, dim: DataFrame, key: str, dim_key: str | None = None) -> DataFrame:
    """``df`` itself if ``dim`` knows all its values; else raises and names some.

    Only distinct values are looked up, so rows that repeat them do not cross a shuffle.
    """
    unknown = orphans(df.select(key).distinct(), dim, key, dim_key).orderBy(key).limit(10).collect()
    if unknown:
        raise UnknownValues(f"unknown {key}: {[r[0] for r in unknown]}")
    return df


class NotIdempotent(AssertionError):
    """A second run changed what the first had written."""


def prove_idempotent(job: Callable[[], dict[str, DataFrame]], raw: DataFrame | None = None, key: str | None = None, typed: str | None = None) -> dict[str, int]:
    """Rows of each table after ``job`` has run twice; raises if the second run changed any count.

    ``job`` writes its tables and returns them. With ``raw``, ``key`` and ``typed``, that typed table must
    have as many rows as ``raw`` has distinct keys.
    """
    first, second = ({name: df.count() for name, df in job().items()} for _ in range(2))
    if first != second:
        raise NotIdempotent(f"rows after one run {first}, after two {second}")
    if raw is not None:
        distinct = raw.select(key).distinct().count()
        if second[typed] != distinct:
            raise NotIdempotent(f"{typed} has {second[typed]} rows for {distinct} keys")
    return second


def check_no_overlap(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Rows whose half-open window begins before an earlier one of their key has ended.

    The running maximum of all earlier ends is compared, so a long window that covers several later
    ones is caught too. A null end is open.
    """
    before = Window.partitionBy(*keys).orderBy(start, F.col(end).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    far = F.lit("9999-12-31 00:00:00").cast(df.schema[end].dataType)
    reach = F.max(F.coalesce(F.col(end), far)).over(before)
    return df.withColumn("_reach", reach).filter(F.col("_reach") > F.col(start)).drop("_reach")
