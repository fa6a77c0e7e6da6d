"""Writers: landing, mirrors that readers see whole, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.merge import merge_insert, merge_update
from . import snapshots


def as_payload(df: DataFrame, key: str) -> DataFrame:
    """Rows as they came: external_id, the whole row as JSON (times in ISO 8601), landed_at."""
    options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "ignoreNullFields": "false"}
    return df.select(F.col(key).cast("string").alias("external_id"), F.to_json(F.struct(*df.columns), options).alias("payload"), F.current_timestamp().alias("landed_at"))


def land_raw(df: DataFrame, key: str, base: DataFrame) -> DataFrame:
    """``base`` with the payloads of ``df``; the latest of a key wins."""
    return merge_update(base, as_payload(df, key), ["external_id"], ["payload", "landed_at"])


def land_capture(df: DataFrame, base: DataFrame) -> DataFrame:
    """Append captures (platform, captured_at, payload); one that is known stays as it is."""
    return merge_insert(base, df.select(*base.columns), ["platform", "captured_at"], [F.col("payload").asc()])


def payloads_for(landed: DataFrame, column: str, values: list) -> DataFrame:
    """What this run landed, read back: typed rows derive from it alone."""
    return landed.filter(F.col(column).isin(values))


def swap(df: DataFrame, target: str) -> None:
    """Replace the table at ``target`` by ``df``, which may read it; readers go through ``read_mirror``.

    A reader sees the old table or the new, whole, and one that began with the old ends with it.
    """
    snapshots.publish(df, target)


def read_mirror(spark: SparkSession, target: str, schema: StructType | str) -> DataFrame:
    """The table that the last ``swap`` put at ``target``; no rows before the first."""
    return snapshots.read(spark, target, "rows", schema)


def export_csv(df: DataFrame, path: str) -> None:
    """The training set as CSV with a header, by platform and time."""
    df.orderBy("platform", "posted_at", "post_id").write.mode("overwrite").option("header", True).csv(path)
