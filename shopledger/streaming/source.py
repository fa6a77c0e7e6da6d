"""A streaming source that pulls landed events by (arrived_at, event_id), with an overlap and a settling time.

``register(spark)`` makes it known; then ``spark.readStream.format("event_pull")`` reads a folder of Parquet
files, the stand-in for a service that is asked for events by time of arrival. Options: ``path``; ``now``
(a file with an ISO time, for tests; else the clock); ``settle`` seconds that events are left to settle;
``overlap`` seconds that a pull goes back before the last one's end; ``parts`` tasks of a pull, by time.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SETTLE, OVERLAP_SECONDS, PARTS = 90, 600, 4
_START = -(1 << 62)


class Slice(InputPartition):
    """Arrivals after ``low`` up to ``high``, in microseconds."""

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class EventPullReader(DataSourceStreamReader):
    """Offsets are the last (arrived_at in microseconds, event_id) that was settled when a pull was planned.

    A pull reads from its start less the overlap, so an event that became visible late is seen by a later
    pull; what is read twice goes by its id downstream. A pull that is repeated reads the same slices.
    """

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path = schema, options["path"]
        self.clock = options.get("now")
        self.settle, self.overlap, self.parts = int(options.get("settle", SETTLE)), int(options.get("overlap", OVERLAP_SECONDS)), int(options.get("parts", PARTS))

    def _now(self) -> int:
        at = datetime.fromisoformat(Path(self.clock).read_text().strip()).replace(tzinfo=timezone.utc).timestamp() if self.clock else time.time()
        return int(at * 1_000_000)

    def _dataset(self):
        import pyarrow.dataset as ds

        return ds.dataset(self.path, format="parquet", exclude_invalid_files=True)

    def _between(self, low: int, high: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        found = self._dataset()
        kind = found.schema.field("arrived_at").type
        stamp = lambda us: pa.scalar(us, pa.timestamp("us", tz="UTC" if getattr(kind, "tz", None) else None)).cast(kind, safe=False)
        where = ds.field("arrived_at") <= stamp(high)
        if low > _START:
            where = where & (ds.field("arrived_at") > stamp(low))
        return found.to_batches(columns=columns, filter=where)

    def initialOffset(self) -> dict[str, Any]:
        return {"arrived_at": _START, "event_id": -1}

    def latestOffset(self) -> dict[str, Any]:
        """The last settled event; the key alone is read."""
        last = (_START, -1)
        for batch in self._between(_START, self._now() - self.settle * 1_000_000, ["arrived_at", "event_id"]):
            at = batch.column("arrived_at").cast(pa.timestamp("us", tz=batch.column("arrived_at").type.tz), safe=False).cast(pa.int64()).to_pylist()
            last = max([last, *zip(at, batch.column("event_id").to_pylist(), strict=True)])
        return {"arrived_at": last[0], "event_id": last[1]}

    def partitions(self, start: dict[str, Any], end: dict[str, Any]) -> list[Slice]:
        if end["arrived_at"] == _START:
            return []
        high = end["arrived_at"]
        if start["arrived_at"] == _START:
            return [Slice(_START, high)]
        low = start["arrived_at"] - self.overlap * 1_000_000 - 1
        step = max(1, -(-(high - low) // self.parts))
        return [Slice(a, min(a + step, high)) for a in range(low, high, step)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in self.schema.fields]
        for batch in self._between(partition.low, partition.high, names):
            if batch.num_rows:  # files may hold nanoseconds without a zone; times are UTC
                columns = [batch.column(n) for n in names]
                columns = [c.cast(pa.timestamp("us", tz="UTC"), safe=False) if pa.types.is_timestamp(c.type) else c for c in columns]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    def commit(self, end: dict[str, Any]) -> None:
        pass


class EventPull(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_pull"

    def schema(self) -> str:
        return "event_id long, occurred_at timestamp, arrived_at timestamp, event_name string, visitor string, session string, url string"

    def streamReader(self, schema: StructType) -> EventPullReader:
        return EventPullReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventPull)
