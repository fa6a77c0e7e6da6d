"""Periodic runs: maximal stretches of words that repeat with some smallest period.

Periods are dealt into octaves: 1-15, 16-31, 32-63, ... An octave of periods below ``B`` has a boundary
at every B-th word, and the tile of a boundary is the B words before it and the 2 B words from it on. A
run of period q has length at least max(24, 3 q), so the stretch of words that equal the word q further on
has 16 words at least, and 2 q: it meets a boundary of its octave. Two Z-functions from a boundary tell
for every q of the octave how far that stretch reaches to either side within the tile. What they find
is shuffled by document and period, and the fragments of a stretch are stitched together there.

A tile is worth solving only if one of the 16 windows of 16 words that hold its boundary comes again less than B
words later; that is decided for all tiles at once, from hashes. A long document's tiles spread over the
tasks in slabs of neighbouring tiles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import importable, materialise, partitions_for

LEAST, TIMES = 24, 3
FIRST = 16
#: A slab of tiles covers at most so many words, or one tile.
SLAB_WORDS = 8192
_BASE = 0x9E3779B97F4A7C15
#: A document's row has words or plain and no octave, a slab's row the rest.
_PREPARED = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("words", pa.binary()), ("plain", pa.string()), ("octave", pa.int64()), ("at", pa.int64()), ("tiles", pa.int64()), ("ids", pa.binary())])
_COLUMNS = "uid long, doc_id long, words binary, plain string, octave long, at long, tiles long, ids binary"
_ROW_BYTES = 8_000_000


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, repeated from some place on in a tenth of the documents, as the contract of the query says."""
    import zlib

    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [*(words[a : a + p] * (-(-(n - a) // p)))][: n - a]


def z_function(s: list[int]) -> list[int]:
    """For each place the length of the longest common prefix of ``s`` and what begins there."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def repeats(ids: np.ndarray, span: int = FIRST) -> np.ndarray:
    """For each window of ``span`` words the distance to the next window of the same hash; the largest number if none."""
    n = len(ids) - span + 1
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(ids), _BASE, dtype=np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * powers)])
        hashes = (sums[span:] - sums[:-span]) * powers[::-1][:n]  # every window brought to the same power
    order = np.argsort(hashes, kind="stable")
    far = np.full(n, np.iinfo(np.int64).max)
    same = hashes[order[1:]] == hashes[order[:-1]]
    far[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return far


def octaves(n: int) -> Iterator[int]:
    """The bounds B of the octaves that a text of ``n`` words can have runs in."""
    bound = FIRST
    yield bound
    while bound <= n // TIMES:
        bound *= 2
        yield bound


def slabs(ids: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    """The tiles that can hold a part of a run, in slabs of neighbours: octave, first boundary, tiles, words."""
    n = len(ids)
    far = repeats(ids) if n >= LEAST else np.zeros(0, dtype=np.int64)
    if not len(far) or far.min() == np.iinfo(np.int64).max:
        return
    for bound in octaves(n):
        near = np.concatenate([[0], np.cumsum(far < bound)])
        at = np.arange(0, n, bound)
        active = at[near[np.minimum(at + 1, len(far))] > near[np.clip(at - FIRST + 1, 0, len(far))]]
        most = max(1, SLAB_WORDS // bound)
        i = 0
        while i < len(active):
            j = i + 1
            while j < len(active) and j - i < most and active[j] == active[j - 1] + bound:
                j += 1
            first, last = int(active[i]), int(active[j - 1])
            yield bound, first, j - i, ids[max(0, first - bound) : last + 2 * bound].astype("<i4").tobytes()
            i = j


def _prime_parts(q: int) -> list[int]:
    """q divided by each of its prime factors."""
    out, rest, p = [], q, 2
    while p * p <= rest:
        if rest % p == 0:
            out.append(q // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return [*out, q // rest] if rest > 1 else out


def solve(words: list[int], boundary: int, bound: int) -> Iterator[tuple[int, int, int]]:
    """(period, low, high): the words low..high-1 around the boundary that equal the word a period later.

    ``boundary`` is an index of ``words``. Stretches that end within the tile and are too short for a
    run are left out, and so are periods that a smaller one explains.
    """
    least = 1 if bound == FIRST else bound // 2
    after = words[boundary : boundary + 2 * bound]
    before = words[max(0, boundary - bound) : boundary][::-1]
    forward = z_function(after)
    # Against what ends q words further on: of the words reversed, the part that begins there.
    wide = words[max(0, boundary - bound) : boundary + bound][::-1]
    backward = z_function([*before, -1, *wide])
    known, skip = len(before), len(before) + 1 + len(after[:bound])
    for q in range(least, min(bound, len(after))):
        ahead = min(forward[q], bound)
        back = min(backward[skip - q], known) if known else 0
        if not ahead + back:
            continue
        open_ = ahead == bound or (known == bound and back == bound)
        if not open_ and ahead + back < max(LEAST - q, (TIMES - 1) * q):
            continue
        if any(forward[r] >= q - r for r in _prime_parts(q) if r < q):
            continue  # the period's own words repeat with period r, so all of the stretch does
        yield q, boundary - back, boundary + ahead


def _solve_slab(ids: np.ndarray, at: int, tiles: int, bound: int) -> list[tuple[int, int, int]]:
    """The stretches of a slab in the document's word numbers, those that touch joined."""
    words, origin = ids.tolist(), max(0, at - bound)
    found: dict[int, list[list[int]]] = {}
    for k in range(tiles):
        b = at + k * bound - origin
        for q, low, high in solve(words, b, bound):
            own = found.setdefault(q, [])
            if own and low <= own[-1][1]:
                own[-1][0], own[-1][1] = min(low, own[-1][0]), max(high, own[-1][1])
            else:
                own.append([low, high])
    return [(q, origin + low, origin + high) for q, all_ in found.items() for low, high in all_]


def _prepare(plant: bool):
    """A row for each document, with its words, and one for each of its slabs; one without slabs is done."""

    def rows(uid: int, doc_id: int | None, text: bytes | None) -> Iterator[tuple]:
        words = (text or b"").split()
        if plant:
            words = planted(words, doc_id)
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
        joined, any_ = b" ".join(words), False
        for slab in slabs(ids):
            any_ = True
            yield uid, doc_id, None, None, *slab
        yield uid, doc_id, joined if any_ else None, None if any_ else hashlib.sha256(joined).hexdigest(), None, None, None, None

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for uid, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                for row in rows(uid, doc_id, text):
                    held.append(row)
                    size += len(row[2] or row[7] or b"")
                    if size > _ROW_BYTES:
                        yield _batch(held)
                        held, size = [], 0
            yield _batch(held)

    return of


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_PREPARED)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PREPARED, strict=True)], schema=_PREPARED)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        out: list[list] = [[], [], [], []]
        for uid, bound, at, tiles, ids in zip(*(rows[c] for c in ("uid", "octave", "at", "tiles", "ids")), strict=True):
            for q, low, high in _solve_slab(np.frombuffer(ids, dtype="<i4"), at, tiles, bound):
                for column, value in zip(out, (uid, q, low, high), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["uid", "period", "low", "high"])


def stitch(fragments: DataFrame) -> DataFrame:
    """(uid, start, length, period) of the runs whose stretches overlap in ``fragments`` (uid, period, low, high)."""
    own = Window.partitionBy("uid", "period").orderBy("low", "high")
    reach = F.max("high").over(own.rowsBetween(Window.unboundedPreceding, -1))
    marked = fragments.withColumn("fresh", F.when(reach >= F.col("low"), 0).otherwise(1))
    marked = marked.withColumn("stretch", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    whole = marked.groupBy("uid", "period", "stretch").agg(F.min("low").alias("start"), (F.max("high") + F.col("period") - F.min("low")).alias("length"))
    return whole.filter((F.col("length") >= LEAST) & (F.col("length") >= TIMES * F.col("period"))).select("uid", "start", "length", "period")


def runs_of(prepared: DataFrame) -> DataFrame:
    """(uid, start, length, period) of every run of the documents prepared by ``_prepare``."""
    spread = prepared.filter("octave IS NOT NULL").select("uid", "octave", "at", "tiles", "ids")
    parts = max(int(prepared.sparkSession.conf.get("spark.sql.shuffle.partitions")), partitions_for(spread.count(), 20_000))
    solved = spread.repartition(parts).mapInArrow(_stretches, "uid long, period long, low long, high long")
    return stitch(solved)


def _longest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run (start, length, period) of the greatest exponent; ``runs`` are in order, and the first of equals counts."""
    best = runs[0]
    for r in runs[1:]:
        if r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The result rows of documents with their runs."""
    empty = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        doc_ids, texts, plain, found = (batch.column(i).to_pylist() for i in range(4))
        out: list[list] = [[] for _ in range(5)]
        digests: list[list] = [[], []]
        for text, digest, rows in zip(texts, plain, found, strict=True):
            runs = sorted((r["start"], r["period"], r["length"]) for r in rows or [])
            if runs:
                runs = [(s, n, q) for s, q, n in runs]
                start, length, period = _longest(runs)
                words = text.split(b" ")
                keep = np.ones(len(words), dtype=bool)
                for s, n, q in runs:
                    keep[s + q : s + n] = False
                values = (len(runs), start, length, period, 1000 * length // period)
                listed = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
                digest = hashlib.sha256(b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])).hexdigest()
            else:
                values, listed = (0, None, None, None, None), empty
                digest = digest or hashlib.sha256(text).hexdigest()
            for column, value in zip(out, values, strict=True):
                column.append(value)
            digests[0].append(listed)
            digests[1].append(digest)
        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), *(pa.array(c, pa.int64()) for c in out), *(pa.array(c, pa.string()) for c in digests)], names=_NAMES)


_NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
_SCHEMA = ", ".join(f"{c} {'string' if c.endswith('sha256') else 'long'}" for c in _NAMES)


def prepare(docs: DataFrame, plant: bool = False) -> DataFrame:
    """The rows of ``_prepare`` for every row of ``docs``, as a table."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialise(rows.mapInArrow(_prepare(plant), _COLUMNS))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, period) of every run in every row of ``docs`` (doc_id, text).

    Nulls and texts of fewer than 24 words have none; rows that repeat a doc_id are separate texts; other
    columns are left out.
    """
    importable(docs.sparkSession)
    prepared = prepare(docs)
    return runs_of(prepared).join(prepared.filter("octave IS NULL").select("uid", "doc_id"), "uid").select("doc_id", "start", "length", "period")


def run_digests(docs: DataFrame, plant: bool = True) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent, and digests of all runs and of the collapsed text.

    One row for each row of ``docs`` (doc_id, text). ``plant`` first repeats words as the query's
    contract says. A null text has no words and a null doc_id is planted nothing; without runs start,
    length, period and exponent_milli are null and the text stays as its words, joined by one space. Equal exponents go by
    start, then period. Texts of any length are read whole; an empty table gives no rows; other columns
    are left out, whatever their names.
    """
    importable(docs.sparkSession)
    prepared = prepare(docs, plant)
    found = runs_of(prepared).groupBy("uid").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    some = prepared.filter("words IS NOT NULL").select("uid", "doc_id", "words", "plain").join(found, "uid", "left").select("doc_id", "words", "plain", "runs")
    none = F.lit(None).cast("array<struct<start:long,length:long,period:long>>")
    rest = prepared.filter("plain IS NOT NULL").select("doc_id", "words", "plain", none.alias("runs"))
    return some.unionByName(rest).mapInArrow(_report, _SCHEMA)
