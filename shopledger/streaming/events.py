"""Web events as a stream: settle, dedupe, land, restate the days that changed."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.exprs import berlin_day, query_value
from ..operators.merge import latest
from ..operators.web import PAGEVIEW, UTM, event_fields, web_traffic_daily
from ..sources import snapshots

OVERLAP, SETTLE_SECONDS, RETENTION_DAYS, REBUILD_DAYS = "10 minutes", 90, 396, 14
EVENTS, ZONE = "events", "Europe/Berlin"
#: How much later than the end of a day its events may come, and how long a visitor may pause within a session.
LATENESS, SESSION_GAP = "1 day", "24 hours"


def resume_point(landed: DataFrame) -> DataFrame:
    """One row: the last (arrived_at, event_id) that was landed; nulls before the first."""
    return landed.agg(F.max(F.struct("arrived_at", "event_id")).alias("last")).select("last.arrived_at", "last.event_id")


def settled(events: DataFrame, now: Column | None = None) -> DataFrame:
    """Without events that arrived within the settling time; they come with a later pull."""
    return events.filter(F.col("arrived_at") <= (now if now is not None else F.current_timestamp()) - F.expr(f"INTERVAL {SETTLE_SECONDS} SECONDS"))


def incremental(events: DataFrame, landed: DataFrame, now: Column, overlap: str = OVERLAP) -> DataFrame:
    """A batch pull: settled arrivals from the resume point less the overlap, within retention."""
    last = landed.agg(F.max("arrived_at").alias("last"))
    start = F.coalesce(F.col("last") - F.expr(f"INTERVAL {overlap}"), F.lit("1970-01-01 00:00:00").cast(landed.schema["arrived_at"].dataType))
    fresh = settled(events, now).filter(F.col("arrived_at") >= now - F.expr(f"INTERVAL {RETENTION_DAYS} DAYS"))
    return fresh.crossJoin(F.broadcast(last)).filter(F.col("arrived_at") >= start).drop("last")  # a side of one row


def dedupe_events(stream: DataFrame, key: str = "event_id", overlap: str = OVERLAP) -> DataFrame:
    """One event of each id; the watermark follows arrival, so late events keep their own day."""
    return stream.withWatermark("arrived_at", overlap).dropDuplicatesWithinWatermark([key])


def day_end(at: Column) -> Column:
    """The instant at which the local day of ``at`` ends."""
    return F.to_utc_timestamp(F.date_add(berlin_day(at), 1).cast("timestamp"), ZONE)


def _by_day(events: DataFrame, lateness: str) -> DataFrame:
    """Events with the summaries' fields and ``day_end``, the event time: a day is over once one more than ``lateness`` later has come."""
    return event_fields(events).withColumn("day_end", day_end(F.col("occurred_at"))).withWatermark("day_end", lateness)


def _counts_stream(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows, distinct sessions and visitors by key, once a day is over.

    Distinct ones are deduplicated first, within the day, then counted: two stateful steps, both of which
    forget a day when the watermark passes its end.
    """
    parts = [rows.select("day_end", *keys, F.lit(name).alias("what"))]
    for one, what in (("session", "sessions"), ("visitor", "visitors")):
        known = rows.filter(F.col(one).isNotNull()).dropDuplicates(["day_end", *keys, one])
        parts.append(known.select("day_end", *keys, F.lit(what).alias("what")))
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("day_end", *keys).agg(*[F.count_if(F.col("what") == w).alias(w) for w in (name, "sessions", "visitors")]).drop("day_end")


def traffic_stream(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """``web_traffic_daily`` as a stream in append mode: each row once, when its day is over.

    Events that come later than that are left to a restatement; those without a time are left out.
    """
    return _counts_stream(_by_day(events, lateness).filter(F.col("event_name") == PAGEVIEW), ["day", "locale"], "pageviews")


def events_stream(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """``web_event_daily`` as a stream in append mode, like ``traffic_stream``."""
    return _counts_stream(_by_day(events, lateness).filter(~F.col("event_name").startswith("$")), ["day", "event_name"], "events")


def first_touch_stream(events: DataFrame, gap: str = SESSION_GAP, lateness: str = OVERLAP) -> DataFrame:
    """The first page view of each session, once the session is over, in append mode.

    The state of a session is one event, and ends when the watermark is ``gap`` past its last page view; a
    session that goes on after so long a pause counts as another. ``ended_at`` is the event time of the row.
    """
    seen = events.filter((F.col("event_name") == PAGEVIEW) & F.col("session").isNotNull()).withWatermark("occurred_at", lateness)
    columns = [c for c in events.columns if c != "session"]
    first = seen.groupBy(F.session_window("occurred_at", gap).alias("stay"), "session").agg(F.min_by(F.struct(*columns), F.struct("occurred_at", "event_id")).alias("f"))
    return first.select("session", *[F.col(f"f.{c}").alias(c) for c in columns], F.window_time("stay").alias("ended_at"))


def acquisition_stream(events: DataFrame, gap: str = SESSION_GAP, lateness: str = OVERLAP) -> DataFrame:
    """Sessions by the day and campaign of their first page view, chained to ``first_touch_stream``, in append mode.

    A row counts the sessions that ended in one hour; ``acquisition_of`` adds up those that have come.
    """
    first = first_touch_stream(events, gap, lateness).withColumn("day", berlin_day(F.col("occurred_at")))
    named = first.select("ended_at", "day", *[F.coalesce(query_value(F.col("url"), u), F.lit("")).alias(u) for u in UTM])
    return named.groupBy(F.window("ended_at", "1 hour").alias("hour"), "day", *UTM).agg(F.count("*").alias("sessions")).drop("hour")


def acquisition_of(rows: DataFrame) -> DataFrame:
    """``web_acquisition_daily`` from the rows of ``acquisition_stream``."""
    return rows.groupBy("day", *UTM).agg(F.sum("sessions").alias("sessions"))


def restate_days(landed: DataFrame, batch: DataFrame, as_of: Column, days: int = REBUILD_DAYS) -> DataFrame:
    """Traffic of the days that a batch touched, from all landed events; days out of the window stay."""
    touched = batch.select(berlin_day(F.col("occurred_at")).alias("day")).distinct().filter(F.col("day") >= F.date_sub(as_of.cast("date"), days))
    whole = landed.withColumn("_day", berlin_day(F.col("occurred_at")))
    return web_traffic_daily(whole.join(F.broadcast(touched), whole["_day"] == touched["day"], "left_semi").drop("_day"))


def land_new(batch: DataFrame, root: str, keys: list[str], order: list[Column], horizon: str | None = None) -> DataFrame:
    """The rows of ``batch``, one of each key, whose key the committed events at ``root`` do not hold.

    Committed events are day-wise by the day of arrival and batch. With a ``horizon`` (an interval) only days from the
    batch's first arrival less the horizon on are searched: no event comes again later than that.
    """
    spark, rows = batch.sparkSession, latest(batch, keys, order)
    current = snapshots.state(spark, root)
    days = None
    if horizon:
        first = batch.agg((F.min("arrived_at") - F.expr(f"INTERVAL {horizon}")).cast("date").cast("string")).first()[0]
        days = [d for d in current["tables"].get(EVENTS, {}).get("days", {}) if first is None or d.split("_")[0] >= first]
    known = snapshots.read(spark, root, EVENTS, batch.schema, days, current)
    return rows.join(known.select(*keys), keys, "left_anti").select(*batch.columns)


def read_events(spark: SparkSession, root: str, schema) -> DataFrame:
    """All committed events."""
    return snapshots.read(spark, root, EVENTS, schema)


def land_batch(batch: DataFrame, number: int, root: str, summaries: Callable[[DataFrame, DataFrame], dict[str, DataFrame]], keys: list[str] = ["event_id"], horizon: str | None = OVERLAP) -> bool:  # noqa: B006
    """Land a batch and what follows from it, all or nothing; returns whether it was new.

    ``summaries`` gets all events, the batch's included, and the batch's new ones, and returns the tables to
    restate, each with a ``day``: the days they hold are replaced. Events and summaries go into one commit under
    the batch's number, so a batch that is repeated after a failure lands once, summaries and all.
    """
    spark = batch.sparkSession
    if number <= snapshots.state(spark, root)["batch"]:
        return False
    batch = batch.persist()
    try:
        fresh = land_new(batch, root, keys, [F.col("arrived_at").asc()], horizon)
        known = read_events(spark, root, batch.schema)
        arrived = fresh.withColumn("_day", F.concat(F.col("arrived_at").cast("date").cast("string"), F.lit(f"_{number}")))
        days = {EVENTS: arrived} | summaries(known.unionByName(fresh), fresh)
        return snapshots.commit(spark, root, number, {}, days)
    finally:
        batch.unpersist()


def prune_events(spark: SparkSession, root: str, as_of: str, days: int = RETENTION_DAYS) -> int:
    """Drop the days of arrival before ``as_of`` less ``days``; returns how many went. No file is rewritten."""
    current = snapshots.state(spark, root)
    first = (date.fromisoformat(as_of) - timedelta(days=days)).isoformat()
    old = [d for d in current["tables"].get(EVENTS, {}).get("days", {}) if d.split("_")[0] < first]
    snapshots.commit(spark, root, current["batch"], {}, dropped={EVENTS: old}, again=True)
    return len(old)


def run_stream(stream: DataFrame, root: str, checkpoint: str, check: Callable[[DataFrame], DataFrame], summaries: Callable[[DataFrame, DataFrame], dict[str, DataFrame]]) -> StreamingQuery:
    """Land what is available: each batch is checked as a whole before any of it is written, and committed whole."""

    def land(batch: DataFrame, number: int) -> None:
        land_batch(check(batch), number, root, summaries)

    return stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
