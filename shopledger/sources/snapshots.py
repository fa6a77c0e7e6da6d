"""Tables that readers see whole: data files in folders of their own, and numbered pointer files that name them.

A commit writes new folders first and then its pointer, complete, by renaming it to the next number.
Readers go by the highest number, so they see the state before or the state after, and a writer that dies
leaves the state before. A pointer names each table's folders, of a day-wise table the folder of each
day, and the last batch that was committed. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

POINTERS = "_state"


def _files(spark: SparkSession, root: str) -> Any:
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    return at.getFileSystem(spark._jsc.hadoopConfiguration())


def _path(spark: SparkSession, *parts: str) -> Any:
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _pointers(spark: SparkSession, root: str) -> list[str]:
    files, at = _files(spark, root), _path(spark, root, POINTERS)
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at)]
    return sorted(n for n in names if n.endswith(".json") and not n.startswith("_"))


def state(spark: SparkSession, root: str) -> dict:
    """What the last pointer says: its ``number``, the last ``batch`` (-1 before the first) and ``tables``."""
    found = _pointers(spark, root)
    if not found:
        return {"number": -1, "batch": -1, "tables": {}}
    stream = _files(spark, root).open(_path(spark, root, POINTERS, found[-1]))
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def point(spark: SparkSession, root: str, new: dict) -> None:
    """Make ``new``, changed from what ``state`` gave, the state; fails if another writer was faster."""
    new = new | {"number": new["number"] + 1}
    files = _files(spark, root)
    at = _path(spark, root, POINTERS, f"{new['number']:012d}.json")
    beside = _path(spark, root, POINTERS, f"_{uuid.uuid4().hex}")
    stream = files.create(beside, False)
    try:
        stream.write(json.dumps(new).encode())
    finally:
        stream.close()
    if files.exists(at) or not files.rename(beside, at):
        files.delete(beside, False)
        raise RuntimeError(f"state {new['number']} of {root} was written by another")


def write(df: DataFrame, root: str, table: str) -> str:
    """Write ``df`` to a new folder below ``root``, which nobody reads yet; returns its path from there."""
    folder = f"{table}/{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{folder}")
    return folder


def write_days(df: DataFrame, root: str, table: str) -> dict[str, str]:
    """Write ``df`` by ``_day``, or else ``day``, to a new folder; returns the folder of each day that it has."""
    spark = df.sparkSession
    folder = f"{table}/{uuid.uuid4().hex}"
    if "_day" not in df.columns:
        df = df.withColumn("_day", F.col("day").cast("string"))
    df.repartition("_day").write.partitionBy("_day").parquet(f"{root}/{folder}")
    files = _files(spark, root)
    names = [s.getPath().getName() for s in files.listStatus(_path(spark, root, folder)) if s.isDirectory()]
    return {n.removeprefix("_day="): f"{folder}/{n}" for n in names if n.startswith("_day=")}


def folders(current: dict, table: str) -> list[str]:
    found = current["tables"].get(table, {})
    return [*found.get("parts", []), *found.get("days", {}).values()]


def read(spark: SparkSession, root: str, table: str, schema: StructType | str, days: list[str] | None = None, current: dict | None = None) -> DataFrame:
    """The committed rows of a table; none if it has no commit yet. ``days`` limits a day-wise table to these.

    The state is taken once, so one plan never mixes two commits.
    """
    current = current or state(spark, root)
    if days is None:
        found = folders(current, table)
    else:
        found = [f for d, f in current["tables"].get(table, {}).get("days", {}).items() if d in days]
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/{f}" for f in found])


def publish(df: DataFrame, root: str, table: str = "rows") -> None:
    """Replace a table by ``df``, which may read it; the old files stay for readers that began before."""
    spark = df.sparkSession
    folder = write(df, root, table)
    current = state(spark, root)
    current["tables"][table] = {"parts": [folder]}
    point(spark, root, current)


def commit(spark: SparkSession, root: str, batch: int, added: dict[str, DataFrame], days: dict[str, DataFrame] | None = None, dropped: dict[str, list[str]] | None = None, again: bool = False) -> bool:
    """One batch as a whole: rows that are added to tables, days that are replaced or dropped in day-wise ones.

    All files come first and the pointer last. A batch that was committed before is left out, unless ``again``;
    returns whether anything was committed.
    """
    current = state(spark, root)
    if batch <= current["batch"] and not again:
        return False
    for table, df in added.items():
        current["tables"].setdefault(table, {}).setdefault("parts", []).append(write(df, root, table))
    for table, df in (days or {}).items():
        current["tables"].setdefault(table, {}).setdefault("days", {}).update(write_days(df, root, table))
    for table, gone in (dropped or {}).items():
        for day in gone:
            current["tables"].get(table, {}).get("days", {}).pop(day, None)
    current["batch"] = batch
    point(spark, root, current)
    return True


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete what only older states name, once no reader of them is left; returns the number of data folders that went."""
    files, current, gone = _files(spark, root), state(spark, root), 0
    for table in current["tables"]:
        kept = folders(current, table)
        for s in files.listStatus(_path(spark, root, table)):
            folder = f"{table}/{s.getPath().getName()}"
            inner = [f for f in kept if f.startswith(f"{folder}/")]
            if folder in kept:
                continue
            if not inner:
                gone += bool(files.delete(s.getPath(), True))
                continue
            for day in files.listStatus(s.getPath()):  # some of its days were written again
                if day.isDirectory() and f"{folder}/{day.getPath().getName()}" not in inner:
                    gone += bool(files.delete(day.getPath(), True))
    for name in _pointers(spark, root)[:-1]:
        files.delete(_path(spark, root, POINTERS, name), False)
    return gone
