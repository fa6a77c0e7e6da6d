"""Target-distribution importance resampling over hashed n-grams.

Each batch of texts interns its n-grams in an open-addressed NumPy table: the key is the n-gram's
XXH64, a taken slot is accepted only if length and bytes are equal too, else the next slot is tried.
A slot stores the n-gram's bucket and its count. Counts by bucket over both corpora give a gain for
each bucket; in a second pass the occurrences' slot ids gather the gains, which are summed by document.
A document's score adds Gumbel noise from its doc_id to its weight, so the highest scores are a
sample without replacement in proportion to exp(weight / 1000).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import importable, materialise, partitions_for, runs_to_index

#: Features are runs of 1 to ``LONGEST`` words.
LONGEST, BUCKETS, SEED = 1, 10_000, 2024
LEAST_WORDS, PERCENT = 20, 10
BYTES_AT_ONCE = 2_000_000
_EMPTY = -1


def _letters() -> bytes:
    """A-Z to lower case; what separates words to a space."""
    keep = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
    lower = {c: c + 32 for c in range(0x41, 0x5B)}
    return bytes(lower.get(c, c if c in keep else 0x20) for c in range(256))


LETTERS = _letters()


class Grams(NamedTuple):
    """The n-grams of some texts: ``data[starts[i]:ends[i]]`` each, ``text`` the number of its text."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray


def grams(texts: list[bytes | None], longest: int) -> tuple[Grams, np.ndarray]:
    """All runs of 1 to ``longest`` words of each text, and its count of words."""
    words = [(t or b"").translate(LETTERS).split() for t in texts]
    n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = [w for ws in words for w in ws]
    data = b" ".join(flat)
    ends = np.cumsum(np.fromiter(map(len, flat), dtype=np.int64, count=len(flat)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)[: len(flat)]
    text = np.repeat(np.arange(len(words)), n)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(flat))  # words from here to the text's end
    parts = [(starts[ok], ends[np.flatnonzero(ok) + size - 1], text[ok]) for size in range(1, longest + 1) for ok in [left >= size]]
    return Grams(data, *(np.concatenate([p[i] for p in parts]) for i in range(3))), n


class Table:
    """An open-addressed table of distinct n-grams with a bucket and a count in each slot."""

    def __init__(self, found: Grams, buckets: int, bits: int | None = None, keys: np.ndarray | None = None):
        import xxhash

        data, a, b, _ = found
        if keys is None:
            keys = np.fromiter((xxhash.xxh64_intdigest(data[i:j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)), dtype=np.uint64, count=len(a))
        bits = bits or max(4, int(2 * len(a)).bit_length())
        mask = (1 << bits) - 1
        owner = np.full(mask + 1, _EMPTY, dtype=np.int64)
        self.slots = (keys & np.uint64(mask)).astype(np.int64)
        raw, open_ = np.frombuffer(data, dtype=np.uint8), np.arange(len(a))
        while len(open_):
            at = self.slots[open_]
            free = open_[owner[at] == _EMPTY]
            owner[self.slots[free][::-1]] = free[::-1]  # of several that claim a slot the first has it
            mine = owner[at]
            open_ = open_[~_equal(raw, keys, a, b, open_, mine)]
            self.slots[open_] = (self.slots[open_] + 1) & mask
        self.count = np.bincount(self.slots, minlength=mask + 1)
        self.bucket = np.zeros(mask + 1, dtype=np.int64)
        taken = np.flatnonzero(owner != _EMPTY)
        first = owner[taken]
        self.bucket[taken] = np.fromiter((zlib.crc32(data[i:j]) % buckets for i, j in zip(a[first].tolist(), b[first].tolist(), strict=True)), dtype=np.int64, count=len(taken))
        self.taken = taken

    def counts(self, buckets: int) -> np.ndarray:
        return np.bincount(self.bucket[self.taken], weights=self.count[self.taken], minlength=buckets).astype(np.int64)


def _equal(raw: np.ndarray, keys: np.ndarray, a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether n-grams x[i] and y[i] have the same key, length and bytes."""
    same = (keys[x] == keys[y]) & (b[x] - a[x] == b[y] - a[y])
    to = np.flatnonzero(same & (x != y))
    if len(to):
        length = (b - a)[x[to]]
        differ = raw[runs_to_index(a[x[to]], length)] != raw[runs_to_index(a[y[to]], length)]
        at = np.cumsum(length) - length
        same[to[np.add.reduceat(differ, at) > 0]] = False  # an n-gram has a byte at least
    return same


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Batches cut so that one holds few bytes, but for a text that is long by itself."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
        at = size = 0
        for i, t in enumerate(texts):
            if i > at and size + len(t or b"") > BYTES_AT_ONCE:
                yield batch.slice(at, i - at), texts[at:i]
                at, size = i, 0
            size += len(t or b"")
        if texts:
            yield batch.slice(at), texts[at:]


def bucket_counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over the whole texts of ``docs``; a task sends at most one row a bucket."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for _, texts in _slices(batches):
            total += Table(grams(texts, longest)[0], buckets).counts(buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    return docs.select("text").mapInArrow(of, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio of target to corpus) for each bucket."""
    both = bucket_counts(docs, longest, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.unionByName(bucket_counts(target, longest, buckets).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    counts = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).toPandas()  # at most ``buckets`` rows
    s, t = np.zeros(buckets), np.zeros(buckets)
    s[counts["bucket"]], t[counts["bucket"]] = counts["s"], counts["t"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 * Gumbel noise) from a hash of the seed and doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features, weight for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch, texts in _slices(batches):
            found, n_words = grams(texts, longest)
            seen = Table(found, len(own))
            n = np.bincount(found.text, minlength=len(texts))
            sums = np.zeros(len(texts), dtype=np.int64)
            np.add.at(sums, found.text, own[seen.bucket[seen.slots]])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n, sums))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, "doc_id long, n_words long, n_features long, weight long")


def _ranked(scored: DataFrame, least_words: int, percent: int) -> DataFrame:
    """Rank the drawn rows: a range sort, row numbers within its partitions, and the counts of those before.

    The draw is at the front of the order (long enough first, then by score and doc_id), so a partition's
    offset is all that its rows need of the others.
    """
    spark = scored.sparkSession
    rows = materialise(scored.withColumns({"short": F.col("n_words") < least_words, "uid": F.monotonically_increasing_id()}))
    total = rows.agg(F.count("*").alias("rows"), F.count_if(~F.col("short")).alias("fit")).first()
    order = [F.col("short"), F.col("score").desc_nulls_last(), F.col("doc_id").asc_nulls_last(), F.col("uid")]
    parts = max(partitions_for(total["rows"]), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = materialise(dealt.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = dealt.groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    sizes = sizes.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    rank = F.col("first") + F.col("place") + 1
    drawn = total["fit"] * percent // 100
    return dealt.join(F.broadcast(sizes), "part").withColumn("rank", F.when(rank <= drawn, rank).cast("long"))


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of ``docs`` (doc_id, text).

    ``target`` (text) is what the draw shall look like. A null or wordless text has no features and
    weight 0; a null doc_id has a null score and is drawn last; equal scores go by the smaller doc_id,
    rows that repeat a doc_id have ranks of their own; undrawn rows have a null rank. Texts of any length
    are read whole; an empty corpus gives no rows, an empty target equal expectations; other columns are
    left out, whatever their names.
    """
    importable(docs.sparkSession)
    weighed = weigh(docs, gains(docs, target, longest, buckets), longest)
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return _ranked(scored, least_words, percent).select("doc_id", "n_features", "weight", "score", "rank")


#: The contract in SQL. The table of the CRC is made by its rule.
ORACLE_SQL = r"""
WITH crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, x)) AS t),
d AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dn AS MATERIALIZED (SELECT r, f, count(*) AS n FROM (SELECT r, unnest(w) AS f FROM d) GROUP BY r, f),
bn AS (SELECT f, count(*) AS n FROM (SELECT unnest(w) AS f FROM b) GROUP BY f),
f AS MATERIALIZED (
  SELECT f, xor(4294967295, list_reduce(list_transform(range(octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT)),
    lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1]), 4294967295)) % 10000 AS bucket
  FROM (SELECT f FROM dn UNION SELECT f FROM bn) CROSS JOIN crc),
n AS (
  SELECT bucket, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM (
    SELECT bucket, n AS s, 0 AS t FROM dn JOIN f USING (f) UNION ALL SELECT bucket, 0, n FROM bn JOIN f USING (f)) GROUP BY bucket),
g AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * (big + 10000) / ((s + 1) * (small + 10000)))) AS BIGINT) AS gain
  FROM n CROSS JOIN (SELECT sum(s) AS big, sum(t) AS small FROM n)),
weights AS (SELECT r, sum(n * gain) AS weight FROM dn JOIN f USING (f) JOIN g USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, r, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (r)),
ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, r) AS place, count(*) OVER () * 10 // 100 AS drawn FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM scored LEFT JOIN ranked USING (r)
"""
