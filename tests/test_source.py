"""The pulling source: settling, overlap, restarts between pulls."""

from datetime import datetime, timedelta

from shopledger.sources import snapshots
from shopledger.streaming import events as st
from shopledger.streaming import source

SCHEMA = "event_id long, occurred_at timestamp, arrived_at timestamp, event_name string, visitor string, session string, url string"
START = datetime(2026, 1, 3, 10)


def test_a_stream_restarted_between_pulls_lands_each_event_once(spark, tmp_path):
    source.register(spark)
    folder, clock, root = f"{tmp_path}/in", tmp_path / "now", f"{tmp_path}/store"

    def come(*rows):
        made = [(i, START, START + timedelta(seconds=s), "$pageview", "v", "s", "/") for i, s in rows]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(folder)

    def pull(at):
        clock.write_text((START + timedelta(seconds=at)).isoformat())
        stream = spark.readStream.format("event_pull").option("path", folder).option("now", str(clock)).load()
        query = stream.writeStream.foreachBatch(lambda df, n: st.land_batch(df, n, root, lambda known, fresh: {})).option("checkpointLocation", f"{tmp_path}/check").start()
        query.processAllAvailable()
        query.stop()
        return sorted(r["event_id"] for r in st.read_events(spark, root, SCHEMA).collect())

    come((1, 0), (2, 10), (3, 100))
    assert pull(105) == [1, 2]  # the third has not settled
    come((4, 5), (5, 300))  # the fourth became visible after a pull that went past it
    assert pull(240) == [1, 2, 3, 4]
    assert pull(241) == [1, 2, 3, 4]
    come((6, 300), (5, 300))
    assert pull(1000) == [1, 2, 3, 4, 5, 6]
    assert snapshots.state(spark, root)["batch"] >= 2


def test_slices_cover_a_pull_without_gaps():
    reader = source.EventPullReader(None, {"path": "x", "parts": "3", "overlap": "10"})
    found = reader.partitions({"arrived_at": 100_000_000, "event_id": 1}, {"arrived_at": 107_000_001, "event_id": 2})
    assert found[0].low == 89_999_999 and found[-1].high == 107_000_001
    assert all(a.high == b.low for a, b in zip(found, found[1:], strict=False))
    first = reader.initialOffset()
    assert reader.partitions(first, first) == [] and len(reader.partitions(first, {"arrived_at": 5, "event_id": 1})) == 1
