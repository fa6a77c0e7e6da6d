"""SimHash near-duplicates by pivot distance tables.

The table holds each fingerprint's Hamming distances to reference fingerprints (pivots): seven in
each of four segments of 16 bits, and their sums, which are distances to pivots over all 64 bits.
By the triangle inequality two fingerprints within r bits differ by at most r in every coordinate,
and by nothing in a segment where their bits agree. Of four segments, r <= 2 differing bits leave
two alike; so the table is joined on the coordinates of any two segments, the pairs of such a cell
that differ by more than r in any coordinate are discarded, and the survivors verified on their
bits. That two segments agree is the pigeonhole of banding; which pairs meet and which are
dropped is decided by distances to pivots alone. ``pivot_report`` counts both.

Cells with many fingerprints are not paired: fingerprints within two bits have a common neighbour
within one bit of both, so each member of such a cell is keyed by itself and its 64 one-bit
neighbours, and all that share a key are linked to the least of them. Both ways are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

SHINGLES_AT_ONCE = 200_000
SEGMENTS, SEGMENT_BITS, PER_SEGMENT = 4, 16, 7
#: A coordinate is a distance from 0 to 16.
VALUES = SEGMENT_BITS + 1


def pivots(seed: int = 10) -> list[int]:
    """The references of a segment."""
    return np.random.default_rng(seed).integers(0, 1 << SEGMENT_BITS, PER_SEGMENT).tolist()


def shingle_hashes(text: str | None, size: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of ``size`` words, repeats included, some at a time.

    A-Z are lower-cased; words are what stands between ASCII white space. A text of fewer words is
    one shingle; one without words has none.
    """
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(size, len(words))
    starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        a, b = starts[at : at + SHINGLES_AT_ONCE].tolist(), ends[at : at + SHINGLES_AT_ONCE].tolist()
        yield np.array([digest(joined[i:j], seed) for i, j in zip(a, b, strict=True)], dtype=np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits set, lowest first."""
    total = np.zeros(64, dtype=np.int64)
    lanes = np.uint64(0x0101010101010101)
    for at in range(0, len(hashes), 255 * 64):
        some = hashes[at : at + 255 * 64]
        edges = np.arange(0, len(some), 255)
        for bit in range(8):  # eight counters of a byte each in a word
            sums = np.add.reduceat((some >> np.uint64(bit)) & lanes, edges)
            total[bit::8] += sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: str | None, size: int) -> int:
    """The text's fingerprint as an unsigned integer; 0 without words."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(text, size):
        counts += bit_counts(hashes)
        n += len(hashes)
    return int(sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist()))


def with_fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), size) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64), pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, "doc_id long, fp long")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def coordinates(fp: Column) -> list[list[Column]]:
    """Distances to the pivots, segment by segment."""
    parts = [F.shiftrightunsigned(fp, i * SEGMENT_BITS).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)) for i in range(SEGMENTS)]
    return [[distance(part, F.lit(p)) for p in pivots()] for part in parts]


def distance_table(fps: DataFrame) -> DataFrame:
    """fp, ``at`` (its coordinates, segment after segment) and ``cells`` (a code for those of each two segments)."""
    of = coordinates(F.col("fp"))
    codes = [reduce(lambda code, d: code * VALUES + d.cast("long"), ds, F.lit(0).cast("long")) for ds in of]
    whole = VALUES**PER_SEGMENT
    cells = [(F.lit(i * whole) + codes[x]) * whole + codes[y] for i, (x, y) in enumerate(combinations(range(SEGMENTS), 2))]
    return fps.select("fp", F.array(*[d.cast("byte") for ds in of for d in ds]).alias("at"), F.array(*cells).alias("cells"))


def _within(radius: int) -> Column:
    """Whether no coordinate of ``at`` and ``at2`` differs by more than ``radius``, nor any sum over the segments."""
    steps = [F.col("at")[i].cast("int") - F.col("at2")[i].cast("int") for i in range(SEGMENTS * PER_SEGMENT)]
    whole = [reduce(Column.__add__, steps[i::PER_SEGMENT]) for i in range(PER_SEGMENT)]
    return reduce(Column.__and__, [F.abs(x) <= radius for x in [*whole, *steps]])


def _cells(fps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cell, fp, at; cell, count of the cells with several fingerprints)."""
    rows = materialise(distance_table(fps)).select(F.explode("cells").alias("cell"), "fp", "at")
    return rows, materialise(rows.groupBy("cell").count().filter("count > 1"))


def _cell_pairs(rows: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """Pairs a < b with their coordinates, of the cells of at most ``most`` fingerprints."""
    small = materialise(rows.join(sizes.filter(F.col("count") <= most).select("cell"), "cell"))
    other = small.select("cell", F.col("fp").alias("b"), F.col("at").alias("at2"))
    return small.select("cell", F.col("fp").alias("a"), "at").join(other, "cell").filter("a < b")


def pivot_report(fps: DataFrame, radius: int = 2, pair_up_to: int = 24) -> DataFrame:
    """One row: ``pairs`` that meet in cells, ``discarded`` by coordinates, ``verified`` on their bits."""
    pairs = _cell_pairs(*_cells(fps), pair_up_to).withColumns({"near": _within(radius), "linked": distance(F.col("a"), F.col("b")) <= radius})
    return pairs.agg(F.count("*").alias("pairs"), F.count_if(~F.col("near")).alias("discarded"), F.count_if(F.col("near") & F.col("linked")).alias("verified"), F.count_if(~F.col("near") & F.col("linked")).alias("lost"))


def fingerprint_links(fps: DataFrame, radius: int, pair_up_to: int = 24) -> DataFrame:
    """Links (a, b) that join exactly the fingerprints reachable by steps of ``radius`` <= 2 bits.

    ``fps``: distinct fp. Rows grow with the fingerprints: at most 6 * ``pair_up_to`` pairs or
    65 keys for each.
    """
    if radius > 2:
        raise ValueError("two equal segments of four are sure up to 2 bits")
    rows, sizes = _cells(fps)
    pairs = _cell_pairs(rows, sizes, pair_up_to).filter(_within(radius)).select("a", "b")
    pairs = pairs.filter(distance(F.col("a"), F.col("b")) <= radius)
    large = rows.select("cell", "fp").join(sizes.filter(F.col("count") > pair_up_to).select("cell"), "cell", "left_semi").select("fp").distinct()
    if radius == 2:
        near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63))) for b in range(64)])
        keyed = large.select("fp", F.explode(near).alias("middle"))
        least = keyed.groupBy("middle").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a < z").select("middle", "a")
        stars = keyed.join(least, "middle").filter("fp > a").select("a", F.col("fp").alias("b"))
    else:
        near = F.array(*[F.col("fp").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63))) for b in range(64)]) if radius else F.array().cast("array<long>")
        keyed = large.select("fp", F.explode(near).alias("b")).filter("fp < b")
        stars = keyed.join(large.select(F.col("fp").alias("b")), "b", "left_semi").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, for nodes that have a link.

    Each round a node takes the least root among itself and its neighbours, and then its root's
    root; the count of changes ends it. Long chains shrink by the second step.
    """
    edges = materialise(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct())
    roots = edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root"))
    roots = materialise(roots)
    while True:
        around = edges.join(roots, edges["v"] == roots["node"]).groupBy("u").agg(F.min("root").alias("near"))
        step = roots.join(around, roots["node"] == around["u"], "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root"))
        step = materialise(step)
        up = step.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        new = materialise(step.join(up, "root", "left").select("node", "old", F.least("root", F.coalesce("higher", "root")).alias("root")))
        roots = new.select("node", "root")
        if not new.filter("root < old").limit(1).count():
            return roots


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row of ``docs`` (doc_id, text).

    Equal fingerprints are one node, so a group of copies, however large, is one row of the work.
    A text without words, or a null, has fingerprint zero, which links like any other. Repeated rows
    give repeated results; a null doc_id gets its component's least known doc_id; an empty table gives
    no rows; other columns are left out.
    """
    rows = materialise(with_fingerprints(docs, size))
    firsts = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(fingerprint_links(firsts.select("fp"), radius))
    named = firsts.join(roots, firsts["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
