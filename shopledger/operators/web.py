"""Web traffic: page views and sessions by local day, first-touch acquisition, named events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import berlin_day, locale_of, normalize_path, path_of, query_value

PAGEVIEW = "$pageview"
ADMIN = r"^/admin(/|$)"
UTM = ("utm_source", "utm_medium", "utm_campaign", "utm_content")


def event_fields(events: DataFrame) -> DataFrame:
    """Events with what all the summaries need; the four share this one plan."""
    path = path_of(F.col("url"))
    return events.withColumns({"day": berlin_day(F.col("occurred_at")), "locale": locale_of(path), "path": normalize_path(path)})


def payload_fields(raw: DataFrame, names: list[str]) -> DataFrame:
    """Landed events (payload as JSON) with the named properties, whatever characters a name has; a missing one is ''."""
    found = F.from_json("payload", "map<string,string>")
    return raw.withColumn("_fields", found).select(*raw.columns, *[F.coalesce(F.try_element_at("_fields", F.lit(n)), F.lit("")).alias(n.lstrip("$")) for n in names])


def _distinct_counts(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows, distinct sessions and visitors by key.

    Repeats of a session and visitor are summed first, so the distinct counts see few rows.
    """
    few = rows.groupBy(*keys, "session", "visitor").agg(F.count("*").alias("n"))
    return few.groupBy(*keys).agg(F.sum("n").alias(name), F.count_distinct("session").alias("sessions"), F.count_distinct("visitor").alias("visitors"))


def web_traffic_daily(events: DataFrame) -> DataFrame:
    return _distinct_counts(event_fields(events).filter(F.col("event_name") == PAGEVIEW), ["day", "locale"], "pageviews")


def web_page_daily(events: DataFrame) -> DataFrame:
    return _distinct_counts(event_fields(events).filter(F.col("event_name") == PAGEVIEW), ["day", "locale", "path"], "pageviews")


def web_event_daily(events: DataFrame) -> DataFrame:
    """The site's own events; names that begin with $ are the tool's."""
    own = event_fields(events).filter(~F.col("event_name").startswith("$"))
    return _distinct_counts(own, ["day", "event_name"], "events")


def first_touch(events: DataFrame) -> DataFrame:
    """The first page view of each session, by time and then id; events without a session are left out.

    An aggregate, not a sort: partial results are merged before the shuffle.
    """
    seen = events.filter((F.col("event_name") == PAGEVIEW) & F.col("session").isNotNull())
    columns = [c for c in events.columns if c != "session"]
    first = seen.groupBy("session").agg(F.min_by(F.struct(*columns), F.struct("occurred_at", "event_id")).alias("f"))
    return first.select("session", *[F.col(f"f.{c}").alias(c) for c in columns])


def web_acquisition_daily(events: DataFrame, from_day: str | None = None) -> DataFrame:
    """Sessions by the day and campaign of their first page view.

    Events from a day before ``from_day`` on are read, so a session that spans midnight is seen from
    its start.
    """
    rows = events.withColumn("day", berlin_day(F.col("occurred_at")))
    if from_day:
        rows = rows.filter(F.col("day") >= F.date_sub(F.lit(from_day).cast("date"), 1))
    first = first_touch(rows)
    if from_day:
        first = first.filter(F.col("day") >= F.lit(from_day).cast("date"))
    named = first.select("day", *[F.coalesce(query_value(F.col("url"), u), F.lit("")).alias(u) for u in UTM])
    return named.groupBy("day", *UTM).agg(F.count("*").alias("sessions"))


def drop_admin(events: DataFrame) -> DataFrame:
    """Without the owner's own visits, judged by ``pathname`` where events have one, else by the URL's path."""
    path = path_of(F.col("url"))
    if "pathname" in events.columns:
        path = F.when(F.col("pathname") != "", F.col("pathname")).otherwise(path)
    return events.filter(~F.coalesce(path.rlike(ADMIN), F.lit(False)))


def rebuild_floor(raw: DataFrame, days: int, as_of, horizon: int = 396) -> DataFrame:
    """One row: the first day that may be rebuilt.

    Never before the oldest day of which raw events remain; once raw data reaches the pruning
    horizon that day is cut through, so the next one is first.
    """
    today = F.lit(as_of).cast("date")
    oldest = raw.agg(F.min(berlin_day(F.col("occurred_at"))).alias("oldest"))
    whole = F.when(F.col("oldest") <= F.date_sub(today, horizon), F.date_add("oldest", 1)).otherwise(F.col("oldest"))
    return oldest.select(F.greatest(F.date_sub(today, days), whole).alias("from_day"))


def rebuild(summary: DataFrame, built: DataFrame, floor: DataFrame) -> DataFrame:
    """``summary`` with the days from the floor on replaced by ``built``; earlier history stays."""
    day = floor.first()[0]
    if day is None:
        return summary
    return summary.filter(F.col("day") < F.lit(day)).unionByName(built.filter(F.col("day") >= F.lit(day)))
