"""Keyed merges over DataFrames: each takes a base and what came in, and returns the new base.

Parquet has no MERGE; these are joins on the key, so a job that runs twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class DuplicateKeys(ValueError):
    """A batch has a key twice and no order says which row wins."""


class EmptyAnswer(ValueError):
    """Nothing arrived where a replacement would erase data."""


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first by ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def _one_row_a_key(inc: DataFrame, keys: list[str], order: list[Column] | None) -> DataFrame:
    if order:
        return latest(inc, keys, order)
    twice = inc.groupBy(*keys).count().filter("count > 1").limit(3).collect()
    if twice:
        raise DuplicateKeys(f"keys arrived twice: {[tuple(r)[:-1] for r in twice]}")
    return inc


def inserted(base: DataFrame, inc: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows of ``inc`` whose key is new, one for each key."""
    return latest(inc, keys, order).join(base.select(*keys), keys, "left_anti").select(*base.columns)


def merge_insert(base: DataFrame, inc: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Insert what is absent; known keys stay as they are."""
    return base.unionByName(inserted(base, inc, keys, order))


def merge_update(base: DataFrame, inc: DataFrame, keys: list[str], update: list[str], order: list[Column] | None = None, when: Column | None = None) -> DataFrame:
    """Upsert: known keys take ``update`` from ``inc`` (where ``when`` holds, over b.* and i.*), others stay."""
    b, i = base.alias("b"), _one_row_a_key(inc, keys, order).withColumn("_in", F.lit(True)).alias("i")
    on = [F.col(f"b.{k}") == F.col(f"i.{k}") for k in keys]
    joined = b.withColumn("_old", F.lit(True)).alias("b").join(i, on, "full_outer")
    fresh = F.col("b._old").isNull()
    change = F.col("i._in").isNotNull() & (when if when is not None else F.lit(True))

    def value(c: str) -> Column:
        if c in keys:
            return F.coalesce(F.col(f"b.{c}"), F.col(f"i.{c}")).alias(c)
        new = F.col(f"i.{c}") if c in inc.columns else F.lit(None)
        taken = fresh | change if c in update else fresh
        return F.when(taken, new).otherwise(F.col(f"b.{c}")).alias(c)

    return joined.select(*[value(c) for c in base.columns])


def merge_newer(base: DataFrame, inc: DataFrame, keys: list[str], ts: str, update: list[str], order: list[Column] | None = None) -> DataFrame:
    """Upsert only where the stored time is null or not after the incoming one."""
    not_older = F.col(f"b.{ts}").isNull() | (F.col(f"b.{ts}") <= F.col(f"i.{ts}"))
    return merge_update(base, inc, keys, update, order, not_older)


def guard_non_empty(base: DataFrame, inc: DataFrame) -> None:
    """Refuse a replacement by nothing where there is something."""
    if inc.isEmpty() and not base.isEmpty():
        raise EmptyAnswer("nothing arrived, and rows would be erased")


def replace_window(base: DataFrame, inc: DataFrame, day: str, start, end, by: Column | None = None) -> DataFrame:
    """Drop the days from start to end (of the rows where ``by`` holds) and put what arrived in place."""
    window = F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    gone = F.coalesce(window & (by if by is not None else F.lit(True)), F.lit(False))
    return base.filter(~gone).unionByName(inc)


def restate_daily(base: DataFrame, inc: DataFrame, keys: list[str], metrics: list[str], fetched_at: Column, order: list[Column] | None = None) -> DataFrame:
    """Later figures of a day replace earlier ones and are stamped; days that did not arrive stay absent."""
    return merge_update(base, inc.withColumn("fetched_at", fetched_at), keys, [*metrics, "fetched_at"], order)


def prune(raw: DataFrame, ts: str, days: int, as_of) -> DataFrame:
    return raw.filter(F.col(ts) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS"))


def new_recipe_version(recipe: DataFrame, changes: DataFrame, as_of) -> DataFrame:
    """Close the open version of each changed pair and open the next one at ``as_of``.

    ``changes``: item_id, ingredient_id, new_qty. A pair whose open version begins at or after
    ``as_of`` is refused by staying as it is.
    """
    at = F.lit(as_of).cast(recipe.schema["active_from"].dataType)
    changed = recipe.join(F.broadcast(changes) if changes.limit(100_001).count() <= 100_000 else changes, ["item_id", "ingredient_id"], "left")
    hit = F.col("new_qty").isNotNull() & F.col("active_to").isNull() & (F.col("active_from") < at)
    closed = changed.withColumn("active_to", F.when(hit, at).otherwise(F.col("active_to")))
    opened = changed.filter(hit).withColumns({"version": F.col("version") + 1, "qty": F.col("new_qty").cast(recipe.schema["qty"].dataType), "active_from": at})
    return closed.select(*recipe.columns).unionByName(opened.select(*recipe.columns))


def append_price_history(ingredient: DataFrame, changes: DataFrame, as_of) -> DataFrame:
    """Put the old price at the end of the history array, then set the new one; others stay."""
    old = F.struct(F.col("current_price").alias("price"), F.lit(as_of).cast("timestamp_ntz").alias("until"), F.lit("manual").alias("source"))
    joined = ingredient.join(changes.select("ingredient_id", "new_price"), "ingredient_id", "left")
    history = F.col("price_history") if "price_history" in ingredient.columns else F.array().cast("array<struct<price:decimal(14,4),until:timestamp_ntz,source:string>>")
    return joined.withColumn("price_history", F.when(F.col("new_price").isNull(), history).otherwise(F.concat(history, F.array(old)))).withColumn(
        "current_price", F.coalesce(F.col("new_price").cast("decimal(14,4)"), "current_price")
    )


def erase(keys: DataFrame, key: str, tables: dict[str, tuple[DataFrame, str, str]]) -> dict[str, DataFrame]:
    """Apply each table's policy to rows that point to an erased key.

    ``tables``: name -> (table, its column, ``set_null`` | ``cascade`` | ``restrict``).
    """
    gone = keys.select(F.col(key).alias("_gone")).distinct()
    out = {}
    for name, (table, column, policy) in tables.items():
        if policy == "restrict":
            if not table.join(gone, table[column] == gone["_gone"], "left_semi").isEmpty():
                raise ValueError(f"{name} still refers to an erased key")
            out[name] = table
        elif policy == "cascade":
            out[name] = table.join(gone, table[column] == gone["_gone"], "left_anti")
        else:
            marked = table.join(gone, table[column] == gone["_gone"], "left")
            out[name] = marked.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).drop("_gone")
    return out
