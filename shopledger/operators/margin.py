"""Margin and cost: frozen costs of the past, current costs of the menu, costs as of a time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import as_double, in_previous_month, nullif_zero, since


def order_cogs(lines: DataFrame) -> DataFrame:
    """Cost of goods of each order, frozen when it was placed."""
    return lines.groupBy("order_id").agg(F.sum(F.col("qty") * F.col("unit_cogs_at_time")).alias("cogs"))


def true_margin(orders: DataFrame, lines: DataFrame, as_of: datetime) -> DataFrame:
    """Margin by channel over the month before ``as_of``, of delivered orders that have lines.

    Lines are summed by order before the join, so an order's gross counts once. Only the orders of
    the month are joined, and no price table is read.
    """
    month = orders.filter((F.col("status") == "delivered") & in_previous_month(F.col("placed_at"), as_of))
    known = month.join(order_cogs(lines), "order_id")
    direct = F.col("channel_fee") + F.col("packaging_cost") + F.col("delivery_cost")
    margin = F.col("gross") - F.col("discounts") - direct - F.col("cogs")
    cached = F.col("net_margin").isNotNull()
    net = F.sum(F.col("gross") - F.col("discounts"))
    return known.groupBy("channel").agg(
        F.count("*").alias("orders"),
        as_double(F.sum("gross"), 2).alias("gross"),
        as_double(F.sum("discounts"), 2).alias("discounts"),
        as_double(F.sum(direct), 2).alias("direct_costs"),
        as_double(F.sum("cogs"), 2).alias("cogs"),
        as_double(F.sum(margin), 2).alias("true_margin"),
        as_double(100 * F.sum(margin) / nullif_zero(net), 1).alias("true_margin_pct"),
        F.count(F.when(~cached, 1)).alias("uncached"),
        as_double(F.coalesce(F.sum(F.when(cached, F.col("net_margin") - margin)), F.lit(0)), 2).alias("cached_margin_drift"),
    )


def cost_steps(recipe: DataFrame, ingredient: DataFrame) -> DataFrame:
    """(item_id, steps): the times at which an item's cost changes, in order, each with the cost from then on.

    A part of a recipe adds its cost at active_from and takes it away at active_to; an item has as many
    steps as its recipe has such times.
    """
    parts = recipe.join(ingredient.select("ingredient_id", "current_price"), "ingredient_id")
    parts = parts.select("item_id", "active_from", "active_to", (F.col("qty") / F.col("yield_factor") * F.col("current_price")).alias("cost"))
    change = F.array(F.struct(F.col("active_from").alias("at"), F.col("cost").alias("by")), F.struct(F.col("active_to").alias("at"), (-F.col("cost")).alias("by")))
    changes = parts.filter(F.col("active_to").isNull() | (F.col("active_to") > F.col("active_from"))).select("item_id", F.explode(change).alias("c")).filter("c.at IS NOT NULL")
    changes = changes.groupBy("item_id", F.col("c.at").alias("at")).agg(F.sum("c.by").cast("decimal(38,8)").alias("by"))
    ordered = changes.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("at", "by"))).alias("changes"))
    zero = F.lit(0).cast("decimal(38,8)")
    empty = F.array().cast("array<struct<at:timestamp_ntz,cost:decimal(38,8)>>")
    add = lambda done, c: F.concat(done, F.array(F.struct(c["at"].cast("timestamp_ntz").alias("at"), (F.coalesce(F.try_element_at(done, F.lit(-1))["cost"], zero) + c["by"]).cast("decimal(38,8)").alias("cost"))))
    return ordered.select("item_id", F.aggregate("changes", empty, add).alias("steps"))


def step_at(steps: Column, at: Column, most: int = 31) -> Column:
    """The cost of the last of ``steps`` that is not after ``at``, null before the first; found by halving.

    ``most`` bounds the halvings: arrays of up to 2 ** most steps.
    """
    start = F.struct(F.lit(0).alias("low"), F.size(steps).alias("high"))  # the answer's place from 1 is in low..high
    def halve(x: Column, _: Column) -> Column:
        middle = F.floor((x["low"] + x["high"] + 1) / 2).cast("int")
        return F.when(x["low"] >= x["high"], x).when(F.get(steps, middle - 1)["at"] <= at, F.struct(middle.alias("low"), x["high"].alias("high"))).otherwise(F.struct(x["low"].alias("low"), (middle - 1).alias("high")))

    halvings = F.sequence(F.lit(1), F.least(F.lit(most), F.ceil(F.log2(F.size(steps) + F.lit(1))).cast("int")))
    return F.get(steps, F.aggregate(halvings, start, halve)["low"] - 1)["cost"]


def unit_cogs_at(lines: DataFrame, recipe: DataFrame, ingredient: DataFrame) -> DataFrame:
    """Each line (order_id, line_no, item_id, placed_at) with the cost of its recipe at that time; 0 without one.

    An item's cost is a step function of time, one row, so a line meets one row whatever the versions of its
    recipe. Lines cross at most one shuffle, on item_id, where adaptive execution splits an item that
    holds many of them.
    """
    return with_unit_cogs(lines.join(cost_steps(recipe, ingredient), "item_id", "left"))


def with_unit_cogs(found: DataFrame) -> DataFrame:
    """Lines (placed_at, steps) with the cost of their steps at that time in place of these; 0 without one."""
    cost = F.coalesce(step_at(F.col("steps"), F.col("placed_at").cast("timestamp_ntz")).cast("decimal(24,8)"), F.lit(0).cast("decimal(24,8)"))
    return found.withColumn("unit_cogs", cost).drop("steps")


def _open_parts(menu: DataFrame, recipe: DataFrame, ingredient: DataFrame) -> DataFrame:
    parts = recipe.filter(F.col("active_to").isNull()).join(ingredient.select("ingredient_id", F.col("slug").alias("ingredient"), F.col("current_price").alias("price")), "ingredient_id")
    return parts.join(menu.select("item_id", "slug", "current_price"), "item_id")


def dish_margin(menu: DataFrame, recipe: DataFrame, ingredient: DataFrame) -> DataFrame:
    """What each dish costs today and earns, by its open recipe and current prices."""
    cost = F.sum(F.col("qty") / F.col("yield_factor") * F.col("price"))
    left = F.col("current_price") - cost
    return _open_parts(menu, recipe, ingredient).groupBy("slug", "current_price").agg(
        as_double(cost, 4).alias("cogs"),
        as_double(left, 2).alias("gross_margin_eur"),
        as_double(100 * left / nullif_zero(F.col("current_price")), 1).alias("gross_margin_pct"),
    ).withColumn("current_price", F.col("current_price").cast("double"))


def recipe_breakdown(menu: DataFrame, recipe: DataFrame, ingredient: DataFrame, slug: str) -> DataFrame:
    """Ingredients of one dish: what to buy and what it costs, dearest first."""
    buy = F.col("qty") / F.col("yield_factor")
    return _open_parts(menu.filter(F.col("slug") == slug), recipe, ingredient).select(
        F.col("slug").alias("dish"), "ingredient", as_double(F.col("qty"), 4).alias("qty"), as_double(F.col("yield_factor"), 4).alias("yield_factor"),
        as_double(buy, 4).alias("gross_qty_to_purchase"), as_double(buy * F.col("price"), 4).alias("line_cost_eur"),
    ).orderBy(F.desc("line_cost_eur"), "ingredient")


def zero_cogs_lines(orders: DataFrame, lines: DataFrame, menu: DataFrame) -> DataFrame:
    """Delivered lines without a cost: a fault of the data, not a free dish."""
    free = lines.filter(F.col("unit_cogs_at_time") == 0).select("order_id", "line_no", "item_id")
    return free.join(orders.filter(F.col("status") == "delivered").select("order_id", "channel", "external_id"), "order_id").join(menu.select("item_id", "name_en"), "item_id").select("channel", "external_id", "line_no", "name_en")


def zero_cogs_count(orders: DataFrame, lines: DataFrame) -> DataFrame:
    free = lines.filter(F.col("unit_cogs_at_time") == 0).select("order_id")
    return free.join(orders.filter(F.col("status") == "delivered").select("order_id"), "order_id").agg(F.count("*").alias("zero_cogs_lines"))


def ad_efficiency(ad_spend: DataFrame, as_of: datetime) -> DataFrame:
    """Spend and cost of an acquired order by platform over the month before ``as_of``."""
    rows = ad_spend.filter(in_previous_month(F.col("day").cast("timestamp_ntz"), as_of))
    return rows.groupBy("platform").agg(
        as_double(F.sum("spend"), 2).alias("spend"),
        F.sum("attributed_orders").alias("attributed_orders"),
        as_double(F.sum("spend") / nullif_zero(F.sum("attributed_orders")), 2).alias("cac_eur"),
    )


def recent_orders(orders: DataFrame, lines: DataFrame, menu: DataFrame, n: int = 50) -> DataFrame:
    """The n most recent order lines; n is the report's length. Ties fall by order and line.

    The newest n orders that have lines hold the newest n lines, so only these are joined.
    """
    newest = orders.join(lines.select("order_id"), "order_id", "left_semi").orderBy(F.desc("placed_at"), "order_id").limit(n)
    return newest.join(lines, "order_id").join(menu.select("item_id", "name_en"), "item_id").orderBy(F.desc("placed_at"), "order_id", "line_no").limit(n).select(
        "channel", "external_id", "placed_at", "status", F.col("gross").cast("double").alias("gross"), "name_en", "line_no", F.col("qty").cast("double").alias("qty"), F.col("unit_price").cast("double").alias("unit_price")
    )


def delivered_zero_cogs(orders: DataFrame, lines: DataFrame, as_of: datetime) -> DataFrame:
    free = lines.filter(F.col("unit_cogs_at_time") == 0).select("order_id")
    return orders.filter((F.col("status") == "delivered") & since(F.col("delivered_at"), 1, as_of)).join(free, "order_id", "left_semi").select("external_id").distinct()


def assert_not_scanned(df: DataFrame, table: str) -> None:
    if any(f"/{table}.parquet" in f for f in df.inputFiles()):
        raise AssertionError(f"the plan reads {table}")
