"""Reading landed tables and payloads; nesting and unnesting of child rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Named columns of a parquet table: what is not named is not read."""
    return spark.read.parquet(path).select(*columns)


def read_jdbc(spark: SparkSession, url: str, table: str, columns: list[str], key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """Named columns of a database table, read in ``parts`` ranges of its key."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), **options)
    return reader.load().select(*columns)


def read_orders(spark: SparkSession, path: str, columns: list[str], order: list[str]) -> DataFrame:
    """Named columns of the source's orders or events in the order they came: by time, then id."""
    return read_rows(spark, path, columns).orderBy(*order)


def read_payloads(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Landed rows (key, payload as JSON text) with the payload parsed by a declared schema."""
    return spark.read.parquet(path).withColumn("data", F.from_json("payload", schema))


def nest_lines(orders: DataFrame, items: DataFrame, key: str, order: str) -> DataFrame:
    """Each order with its items as an array in order; items of no order go, an order of none has []."""
    rest = [c for c in items.columns if c not in (key, order)]
    nested = items.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *rest))).alias("lines"))
    kind = nested.schema["lines"].dataType
    return orders.join(nested, key, "left").withColumn("lines", F.coalesce("lines", F.array().cast(kind)))


def explode_lines(nested: DataFrame, key: str) -> DataFrame:
    """One row for each line, numbered from 1 in the array's order."""
    return nested.select(key, F.posexplode("lines").alias("_at", "line")).select(key, (F.col("_at") + 1).alias("position"), "line")
