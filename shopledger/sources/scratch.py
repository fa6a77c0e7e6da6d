"""Intermediate tables in the folder that all machines share; they go when the session ends."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the shared folder the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, as in tests, a temporary folder of this machine is set once; on a cluster,
    whose machines do not share it, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="shopledger-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Cuts lineage so that a lost executor costs one read, not a recomputation, and
    fixes the outcome of steps whose order may differ between two runs.
    """
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession | None = None) -> None:
    """Delete the tables of ``spark``, or of all sessions, that are still there."""
    kept = []
    for session, path in _made:
        if spark is not None and session is not spark:
            kept.append((session, path))
            continue
        with contextlib.suppress(Exception):  # the session may have ended
            at = session._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(session._jsc.hadoopConfiguration()).delete(at, True)
    _made[:] = kept


atexit.register(clear)
