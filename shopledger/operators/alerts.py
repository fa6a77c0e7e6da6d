"""Detectors' verdicts and the life of alerts: open, converge, resolve."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import since
from .margin import delivered_zero_cogs

VERDICT = ("agent", "alert_key", "triggered", "severity", "title", "detail")


# The titles and details of alerts are fixed values: readers and tests go by them.


def _verdict(df: DataFrame, agent: str, key: str, fired, severity: str, title, detail) -> DataFrame:
    text = lambda x: F.when(fired, x)
    return df.select(F.lit(agent).alias("agent"), F.lit(key).alias("alert_key"), fired.alias("triggered"), text(F.lit(severity)).alias("severity"), text(title).alias("title"), text(detail).alias("detail"))


def detect_no_orders(orders: DataFrame, as_of: datetime) -> DataFrame:
    """Critical if the last seven days have no order; one row, also over no rows."""
    n = orders.agg(F.count(F.when(since(F.col("placed_at"), 7, as_of), 1)).alias("n"))
    return _verdict(n, "operations-detector", "no_orders_7d", F.col("n") == 0, "critical", F.lit("No new orders in the last 7 days"), F.lit("Nothing was placed in the last week: check that the shop can be reached."))


def detect_zero_cogs(orders: DataFrame, lines: DataFrame, as_of: datetime) -> DataFrame:
    """Warns of orders delivered in the last day with a line without cost: up to 20 are counted, ten shown."""
    ids = delivered_zero_cogs(orders, lines, as_of).orderBy("external_id").limit(20)
    found = ids.agg(F.sort_array(F.collect_list("external_id")).alias("ids"))
    n = F.size("ids")
    shown = F.concat(F.lit("orders: "), F.array_join(F.slice("ids", 1, 10), ", "), F.when(n > 10, " …").otherwise(""))
    return _verdict(found, "finance-detector", "zero_cogs_delivered_orders", n > 0, "warn", F.concat(n.cast("string"), F.lit(" delivered order(s) with no cost in the last 24h")), shown)


def upsert_alerts(alerts: DataFrame, results: DataFrame, as_of: datetime) -> DataFrame:
    """Alerts after the detectors' ``results``: one open row at most for each agent and key.

    A triggered result opens a row or refreshes the open one, whose detected_at stays; one that does
    not trigger resolves the open row; resolved rows are history and stay.
    """
    at = F.lit(as_of).cast("timestamp_ntz")
    is_open = F.col("resolved_at").isNull()
    history, now_open = alerts.filter(~is_open), alerts.filter(is_open)
    o, r = now_open.alias("o"), results.alias("r")
    joined = o.join(r, (F.col("o.agent") == F.col("r.agent")) & (F.col("o.alert_key") == F.col("r.alert_key")), "full_outer")
    new = F.col("o.agent").isNull()
    fired = F.coalesce(F.col("r.triggered"), F.lit(False))
    clear = ~new & F.col("r.agent").isNotNull() & ~fired
    live = joined.filter(~new | fired)
    fresh = lambda c: F.when(fired, F.col(f"r.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    live = live.select(
        F.coalesce("o.agent", "r.agent").alias("agent"), F.coalesce("o.alert_key", "r.alert_key").alias("alert_key"),
        fresh("severity"), fresh("title"), fresh("detail"),
        F.coalesce(F.col("o.detected_at"), at).alias("detected_at"), F.col("o.acknowledged_at").alias("acknowledged_at"),
        F.when(clear, at).alias("resolved_at"), F.when(clear, F.lit("auto")).alias("resolution"),
    )
    return history.select(*live.columns).unionByName(live)
