"""What the operators share: scratch tables, prefix sums, word patterns."""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialise, scratch_dir

__all__ = ["ascii_lower", "documents", "importable", "materialise", "numbered_within", "partitions_for", "runs_to_index", "scratch_dir", "table", "unused", "whole_partition"]

#: White space of the word contracts: space and the five ASCII controls from tab to return.
ASCII_SPACE = r"[\x20\x09-\x0D]+"
#: Settings that count rows in a batch: their default, and ours in its place; what a user set is kept. A Parquet
#: reader holds a batch's texts of a column in one array, and doubles it: 20 MB and more of heap in one piece by default.
BATCH_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.parquet.columnarReaderBatchSize": ("4096", "512")}
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def importable(spark: SparkSession) -> None:
    """Let Python workers that see this folder import the package, wherever the driver was started.

    Rows here are whole texts, so the default counts of rows in a batch are lowered.
    """
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    for setting, (default, lower) in BATCH_ROWS.items():
        if spark.conf.get(setting) == default:
            spark.conf.set(setting, lower)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, UPPER.lower())


def whole_partition(batches: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    """All batches of a partition whose size the caller has bounded; None if it has no rows."""
    frames = [b for b in batches if len(b)]
    return pd.concat(frames, ignore_index=True) if frames else None


def partitions_for(rows: int, per_partition: int = 200_000) -> int:
    return max(1, math.ceil(rows / per_partition))


def numbered_within(df: DataFrame, group: str, order: list[str], name: str, chunk_rows: int = 50_000) -> DataFrame:
    """Number the rows of each group gaplessly from 0, however large a group is.

    Each group is dealt into chunks by a hash of the order columns; a chunk's first number is
    the count of all chunks before it (a table of groups times chunks), and rows are numbered
    only within their chunk. ``group`` must have few values.
    """
    chunks = partitions_for(df.count(), chunk_rows)
    dealt = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int"))
    counts = dealt.groupBy(group, "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(group, "_chunk").orderBy(*order)
    return (
        dealt.join(counts, [group, "_chunk"])
        .withColumn(name, (F.col("_first") + F.row_number().over(inside) - 1).cast("long"))
        .drop("_chunk", "_first")
    )


def runs_to_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of each run, one run after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
