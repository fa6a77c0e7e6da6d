"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

Documents longer than a sequence are cut into full pieces behind a shorter first one. Full pieces
are sequences of their own, pieces over half a sequence open one, and the rest goes by halving
size classes from large to small. A round range-sorts the class's pieces and the sequences' gaps by
size, and sweeps down: each piece takes the smallest gap at least its size that is still free.
That is the matching of brackets (a gap opens, a piece closes), so each partition matches by itself
and leaves some pieces, then some gaps; these meet across partitions by their ranks, from counts
only. Gaps are then updated and the round repeats. A gap of many times the class's size is offered
as several parts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions_for, whole_partition
from .tokens import TEXTS_AT_ONCE, encoder, release

PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
SWEPT = "kind int, uid long, bin long, gap long, length long, part int, rank long"
MATCHED, GAP, PIECE = 0, 1, 2


def cut_documents(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of at most ``capacity`` ids, each with a number of its own (``uid``)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            for at in range(0, len(batch), TEXTS_AT_ONCE):
                some = batch.slice(at, TEXTS_AT_ONCE)
                ids, counts = encoder(vocabulary).encode(some.column(1), end_id)
                data = memoryview(ids.astype("<u4").tobytes())
                n_pieces = -(-counts // capacity)
                row = np.repeat(np.arange(len(counts)), n_pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                head = counts - (n_pieces - 1) * capacity
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[row], capacity)
                place = 4 * (start + (np.cumsum(counts) - counts)[row])
                sums = [zlib.crc32(data[a : a + 4 * n]) for a, n in zip(place.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(uid + np.arange(len(row)), pa.int64()), some.column(0).take(pa.array(row)),
                        pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(sums, pa.int64()),
                    ],
                    names=["uid", "doc_id", "piece", "start", "length", "ids_crc32"],
                )
                uid += len(row)
                release()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def match_sorted(is_gap: np.ndarray) -> np.ndarray:
    """For rows in descending size, gaps before pieces of their size: each piece's row of its gap, else -1."""
    level = np.cumsum(np.where(is_gap, 1, -1))
    key = np.where(is_gap, level, level + 1)
    order = np.lexsort((np.arange(len(key)), key))
    taken = np.full(len(is_gap), -1, dtype=np.int64)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        pair = (key[a] == key[b]) & is_gap[a] & ~is_gap[b]
        taken[b[pair]] = a[pair]
    return taken


def _sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = whole_partition(frames)
    if rows is None:
        return
    is_gap = rows["is_gap"].to_numpy()
    taken = match_sorted(is_gap)
    found = taken >= 0
    free_gap = is_gap.copy()
    free_gap[taken[found]] = False
    left = ~is_gap & ~found
    n = len(rows)
    kind = np.where(found, MATCHED, np.where(left, PIECE, GAP))
    bins, gaps = rows["bin"].to_numpy().copy(), rows["gap"].to_numpy().copy()
    bins[found], gaps[found] = bins[taken[found]], gaps[taken[found]]
    rank = np.zeros(n, dtype=np.int64)
    rank[left], rank[free_gap] = np.arange(left.sum()), np.arange(free_gap.sum())
    keep = ~is_gap | free_gap
    yield pd.DataFrame(
        {
            "kind": kind.astype(np.int32), "uid": rows["uid"], "bin": bins, "gap": gaps, "length": rows["length"],
            "part": np.int32(TaskContext.get().partitionId()), "rank": rank,
        }
    )[keep]


def _join_leftovers(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(piece part, first rank, end rank, gap part, gap rank of the first; the next ones go down).

    ``counts`` has (part, left pieces, left gaps) in descending order of size.
    """
    free: list[list[int]] = []
    out = []
    for part, pieces, gaps in counts:
        at = 0
        while at < pieces and free:
            n = min(pieces - at, free[-1][1])
            out.append((part, at, at + n, free[-1][0], free[-1][1] - 1))
            free[-1][1] -= n
            at += n
            if not free[-1][1]:
                free.pop()
        if gaps:
            free.append([part, gaps])
    return out


def match_round(pieces: DataFrame, gaps: DataFrame, parts: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Best-fit one piece into each gap on offer: (placed pieces, gaps after it, pieces left).

    ``pieces``: uid, length. ``gaps``: bin, gap, and in ``slots`` into how many parts a gap is
    offered, each able to take one piece.
    """
    spark = pieces.sparkSession
    parted = gaps.withColumn("slot", F.explode(F.sequence(F.lit(1), "slots")))
    size = F.floor(F.col("gap") / F.col("slots"))
    rows = parted.select(
        (-2 * size - 1).alias("key"), F.lit(True).alias("is_gap"), F.lit(-1).cast("long").alias("uid"), "bin", "gap", size.alias("length"), F.xxhash64("bin", "slot").alias("tie")
    ).unionByName(
        pieces.select((-2 * F.col("length")).alias("key"), F.lit(False).alias("is_gap"), "uid", F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("gap"), "length", F.xxhash64("uid").alias("tie"))
    )
    # a round within the bound of one partition needs no exchange at all
    dealt = rows.repartitionByRange(parts, "key", "tie") if parts > 1 else rows.coalesce(1)
    swept = materialise(dealt.sortWithinPartitions("key", "tie").mapInPandas(_sweep, SWEPT))
    swept = swept if parts > 1 else swept.coalesce(1)
    by_part = swept.groupBy("part").agg(*[F.count(F.when(F.col("kind") == k, 1)) for k in (PIECE, GAP)]).orderBy("part").collect()
    placed = swept.filter(F.col("kind") == MATCHED).select("uid", "bin", "length")
    used = F.sum(F.when(F.col("kind") == MATCHED, F.col("length")).otherwise(0))
    after = swept.filter(F.col("kind") != PIECE).groupBy("bin").agg((F.max("gap") - used).alias("gap"))
    left = swept.filter(F.col("kind") == PIECE).select("uid", "length", "part", "rank")
    segments = _join_leftovers([tuple(r) for r in by_part])
    if segments:  # at most two for each partition
        table = spark.createDataFrame(segments, "part int, low long, high long, gap_part int, gap_rank long")
        across = left.join(F.broadcast(table), "part").filter((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
        across = across.select("uid", "length", "gap_part", (F.col("gap_rank") - F.col("rank") + F.col("low")).alias("gap_rank"))
        free = swept.filter(F.col("kind") == GAP).select(F.col("part").alias("gap_part"), F.col("rank").alias("gap_rank"), "bin")
        across = materialise(across.join(free, ["gap_part", "gap_rank"]).select("uid", "bin", "length"))
        placed = placed.unionByName(across)
        more = across.groupBy("bin").agg(F.sum("length").alias("more"))
        after = after.join(more, "bin", "left").select("bin", (F.col("gap") - F.coalesce("more", F.lit(0))).alias("gap"))
        left = left.join(across, "uid", "left_anti")
    return placed, after.filter("gap > 0"), left.select("uid", "length")


def _histograms(gaps: DataFrame, left: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """Counts by size, of which there are at most as many as a sequence has places."""
    both = gaps.select(F.lit(True).alias("is_gap"), F.col("gap").alias("size")).unionByName(left.select(F.lit(False).alias("is_gap"), F.col("length").alias("size")))
    rows = both.groupBy("is_gap", "size").count().collect()
    return {r[1]: r[2] for r in rows if r[0]}, {r[1]: r[2] for r in rows if not r[0]}


def best_fit(pieces: DataFrame, capacity: int, part_rows: int = 200_000) -> DataFrame:
    """Place pieces (uid, length between 1 and ``capacity``) into bins: (uid, bin, length).

    Driver memory is two histograms by size, at most ``capacity`` rows each, and a few counts for
    each partition. Lengths that many pieces share are spread by a hash of the piece.
    """
    spark = pieces.sparkSession
    waiting_sizes = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    half = capacity // 2
    opened = pieces.filter(F.col("length") > half).select("uid", F.col("uid").alias("bin"), "length")
    gaps = opened.filter(F.col("length") < capacity).select("bin", (capacity - F.col("length")).alias("gap"))
    gap_sizes = {capacity - s: n for s, n in waiting_sizes.items() if half < s < capacity}
    waiting_sizes = {s: n for s, n in waiting_sizes.items() if s <= half}
    placed, fresh = opened, -1
    while waiting_sizes:
        high = max(waiting_sizes)
        low = high // 4 if high > 16 else 0
        sizes = {s: n for s, n in waiting_sizes.items() if s > low}
        waiting_sizes = {s: n for s, n in waiting_sizes.items() if s <= low}
        waiting, fitted = pieces.filter((F.col("length") > low) & (F.col("length") <= high)).select("uid", "length"), True
        while sizes:
            smallest, n, volume = min(sizes), sum(sizes.values()), sum(s * k for s, k in sizes.items())
            usable = sum(g * k for g, k in gap_sizes.items() if g >= smallest)
            # sequences that any packing needs beside the open ones; at least one if nothing fitted
            new = max(-(-(volume - usable) // capacity), 0 if fitted and usable else 1)
            if new > 0:
                gaps = gaps.unionByName(spark.range(new).select((fresh - F.col("id")).alias("bin"), F.lit(capacity).cast("long").alias("gap")))
                fresh -= new
                gap_sizes[capacity] = gap_sizes.get(capacity, 0) + new
            n_gaps = sum(k for g, k in gap_sizes.items() if g >= smallest)
            most = max(1, -(-2 * n // n_gaps))
            slots = F.greatest(F.lit(1), F.least(F.floor(F.col("gap") / max(sizes)), F.lit(most))).cast("int")
            offered = sum(k * max(1, min(g // max(sizes), most)) for g, k in gap_sizes.items())
            found, gaps, waiting = match_round(waiting, gaps.withColumn("slots", slots), partitions_for(n + offered, part_rows))
            placed = placed.unionByName(found)
            gap_sizes, sizes = _histograms(gaps, waiting)
            fitted = sum(sizes.values()) < n
    return placed


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of ``docs``.

    A null text is empty and has only the end id. Rows of one doc_id, or of one text, are packed
    each for itself; an empty table gives no rows; other columns are left out. Ties of size
    fall by a hash of the piece.
    """
    pieces = materialise(cut_documents(docs, vocabulary, capacity, end_id))
    bins = best_fit(pieces.select("uid", "length"), capacity)
    inside = Window.partitionBy("sequence_id").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    return (
        pieces.join(bins.select("uid", F.col("bin").alias("sequence_id")), "uid")
        .withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long"))
        .drop("uid")
    )
