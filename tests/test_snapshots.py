"""Atomic tables and batches: readers in a loop, crashes after each step, days that stay untouched."""

import os
import threading
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shopledger.operators.web import web_traffic_daily
from shopledger.sources import sinks, snapshots
from shopledger.streaming import events as st

SCHEMA = "event_id long, occurred_at timestamp, arrived_at timestamp, event_name string, visitor string, session string, url string"


def event(i, day, late=0, minute=1):
    return (i, datetime(2026, 1, day, 10), datetime(2026, 1, day + late, 10, minute), "$pageview", f"v{i % 3}", f"s{i % 4}", "/de/x")


def traffic(known, fresh):
    return {"traffic": st.restate_days(known, fresh, F.lit(datetime(2026, 1, 20)), 60)}


def test_readers_never_see_an_empty_or_a_half_table(spark, tmp_path):
    root, stop, seen, faults = str(tmp_path / "mirror"), threading.Event(), [], []
    sinks.swap(spark.range(200).withColumn("v", F.lit(0)), root)

    def reader():
        while not stop.is_set():
            try:
                seen.append(tuple(sinks.read_mirror(spark, root, "id long, v int").agg(F.count("*"), F.min("v"), F.max("v")).first()))
            except Exception as e:  # noqa: BLE001
                faults.append(e)

    thread = threading.Thread(target=reader)
    thread.start()
    for k in range(1, 6):
        sinks.swap(spark.range(200 + k).repartition(5).withColumn("v", F.lit(k)), root)
    stop.set()
    thread.join()
    assert not faults and len(seen) > 3
    assert all(n == 200 + low and low == high for n, low, high in seen)


def test_a_table_may_be_replaced_by_itself_and_old_files_go(spark, tmp_path):
    root = str(tmp_path)
    assert sinks.read_mirror(spark, root, "id long").count() == 0
    sinks.swap(spark.range(3), root)
    sinks.swap(sinks.read_mirror(spark, root, "id long").unionByName(spark.range(3, 5)), root)
    assert sorted(r["id"] for r in sinks.read_mirror(spark, root, "id long").collect()) == [0, 1, 2, 3, 4]
    assert snapshots.vacuum(spark, root) == 1 and snapshots.vacuum(spark, root) == 0
    assert sinks.read_mirror(spark, root, "id long").count() == 5


def test_a_slower_writer_is_refused(spark, tmp_path):
    old = snapshots.state(spark, str(tmp_path))
    snapshots.point(spark, str(tmp_path), old)
    with pytest.raises(RuntimeError, match="another"):
        snapshots.point(spark, str(tmp_path), old)


@pytest.mark.parametrize("broken", ["write_days", "second table", "point", "after"])
def test_a_crash_leaves_all_or_nothing(spark, tmp_path, monkeypatch, broken):
    root = str(tmp_path / "store")
    first = spark.createDataFrame([event(1, 1), event(2, 1), event(1, 1)], SCHEMA)
    assert st.land_batch(first, 0, root, traffic)
    second = spark.createDataFrame([event(2, 1), event(3, 1, late=1), event(4, 2)], SCHEMA)
    called, real = [], {n: getattr(snapshots, n) for n in ("write_days", "point")}

    def fail(*args):
        called.append(args)
        if broken == "second table" and len(called) < 2:
            return real["write_days"](*args)
        if broken == "after":
            real["point"](*args)
        raise OSError("lost")

    monkeypatch.setattr(snapshots, {"second table": "write_days", "after": "point"}.get(broken, broken), fail)
    with pytest.raises(OSError, match="lost"):
        st.land_batch(second, 1, root, traffic)
    monkeypatch.undo()

    def rows():
        events = sorted(r["event_id"] for r in st.read_events(spark, root, SCHEMA).collect())
        days = {str(r["day"]): r["pageviews"] for r in snapshots.read(spark, root, "traffic", "day date, locale string, pageviews long, sessions long, visitors long").collect()}
        return events, days

    old, new = ([1, 2], {"2026-01-01": 2}), ([1, 2, 3, 4], {"2026-01-01": 3, "2026-01-02": 1})
    assert rows() == (new if broken == "after" else old)
    assert st.land_batch(second, 1, root, traffic) == (broken != "after")  # as the stream repeats it
    assert rows() == new
    assert not st.land_batch(second, 1, root, traffic) and rows() == new


def test_a_rebuild_and_a_prune_leave_other_days_files_alone(spark, tmp_path):
    root = str(tmp_path / "store")
    st.land_batch(spark.createDataFrame([event(i, 1 + i) for i in range(5)], SCHEMA), 0, root, traffic)
    files = lambda: {str(p): os.stat(p).st_mtime_ns for p in Path(root).rglob("*.parquet")}
    before = files()
    st.land_batch(spark.createDataFrame([event(9, 3)], SCHEMA), 1, root, traffic)
    assert before.items() <= files().items()
    current = snapshots.state(spark, root)
    moved = {d for d, f in current["tables"]["traffic"]["days"].items() if not any(f in p for p in before)}
    assert moved == {"2026-01-03"}
    assert st.prune_events(spark, root, "2026-01-20", days=17) == 2
    assert sorted(r["event_id"] for r in st.read_events(spark, root, SCHEMA).collect()) == [2, 3, 4, 9]
    assert before.items() <= files().items()
    assert snapshots.vacuum(spark, root) == 3
    assert {p for p in before if "2026-01-04" in p or "2026-01-05" in p} <= set(files())
    assert snapshots.read(spark, root, "traffic", "day date, pageviews long").agg(F.sum("pageviews")).first()[0] == 6


def test_the_stream_commits_whole_batches_and_equals_the_batch_tables(spark, tmp_path):
    root = str(tmp_path / "store")

    def run(rows, check=lambda df: df):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        st.run_stream(st.dedupe_events(stream), root, f"{tmp_path}/check", check, traffic).awaitTermination()

    run([event(1, 1), event(2, 1), event(1, 1)])

    def refuse(df):
        raise ValueError("leak")

    with pytest.raises(Exception, match="leak"):
        run([event(3, 2), event(4, 1, late=1)], refuse)
    assert st.read_events(spark, root, SCHEMA).count() == 2
    run([event(5, 3)])
    whole = st.read_events(spark, root, SCHEMA)
    assert sorted(r["event_id"] for r in whole.collect()) == [1, 2, 3, 4, 5]
    stored = snapshots.read(spark, root, "traffic", web_traffic_daily(whole).schema)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, web_traffic_daily(whole).collect()))
