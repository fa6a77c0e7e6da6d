"""Daily questions of operations: counts, queues, customers, rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return union_all([df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, df in tables.items()])


def repeat_customers(orders: DataFrame) -> DataFrame:
    """How many known customers ordered once, and how many more often."""
    by = orders.filter(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(F.count("*").alias("n"))
    return by.agg(F.count(F.when(F.col("n") == 1, 1)).alias("one_time"), F.count(F.when(F.col("n") > 1, 1)).alias("repeat_customers"))


def review_queue(reviews: DataFrame) -> DataFrame:
    """Unreplied reviews under four stars, newest first; unrated ones are none."""
    return reviews.filter(F.col("replied_at").isNull() & (F.col("rating") < 4)).select("review_id", "source", "rating", "text", "posted_at").orderBy(F.desc("posted_at"), "review_id")


def pending_actions(actions: DataFrame) -> DataFrame:
    return actions.filter(F.col("status").isin("proposed", "queued")).orderBy("proposed_at", "action_id")


def action_outcomes(actions: DataFrame) -> DataFrame:
    return actions.filter(F.col("status").isin("approved", "rejected", "expired")).groupBy("status").agg(F.count("*").alias("n"))


def open_alerts(alerts: DataFrame) -> DataFrame:
    """Unresolved alerts, the gravest first, then the newest."""
    grade = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warn", 1).otherwise(2)
    return alerts.filter(F.col("resolved_at").isNull()).orderBy(grade, F.desc("detected_at"), "alert_key")


def ingredient_suppliers(ingredient: DataFrame, supplier: DataFrame) -> DataFrame:
    """Every ingredient and its supplier's name, null without one."""
    names = supplier.select(F.col("supplier_id"), F.col("name").alias("supplier"))
    return ingredient.select("slug", "supplier_id").join(names, "supplier_id", "left").select("slug", "supplier")


def supplier_ranking(supplier: DataFrame, score: str) -> DataFrame:
    return supplier.orderBy(F.desc_nulls_last(score), "slug")


def menu_by_price(menu: DataFrame) -> DataFrame:
    return menu.select("slug", "category", F.col("current_price").cast("double").alias("current_price")).orderBy("current_price", "slug")


def top_distinct(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """The first n distinct values in order; n is the report's length."""
    return df.select(column).distinct().orderBy(column).limit(n)


def preview(df: DataFrame, by: str, n: int) -> DataFrame:
    """The n most frequent values: what a dry run shows and nothing writes."""
    return df.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(n)


def placeholder_prices(ingredient: DataFrame) -> DataFrame:
    """Ingredients whose last price in the history still is a placeholder."""
    return ingredient.filter(F.element_at("price_history", -1)["source"] == "placeholder").select("ingredient_id", "slug")
