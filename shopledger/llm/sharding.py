"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Groups of equal texts are placed whole where the dot product of their share of the totals with a
shard's residual capacity is highest, the largest first. Groups of nearly the same load (within a
quarter of an octave of bytes, half of one of tokens and rows) form a class, and groups of a class are
alike to the placement: those of a small class are placed one by one by their own loads, those of a
large one by the class's mean in batches, of which each is a small part of a shard. So the driver sees
a number of loads that grows with the logarithm of the sizes, not with the groups. A last remainder of
a 32nd of the groups, pooled by a hash, is placed by what the shards really hold by then. A group too
large for that is split by a hash of its rows. Tokens are counted as runs of letters, of digits and
of other visible characters, the cut that byte-level vocabularies make before their merges.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, numbered_within

#: Groups placed one by one in a class, parts of a shard that a batch is at most, pools of the remainder.
SINGLY, PARTS, POOLS, REMAINDER = 64, 512, 512, 32
#: Shares of one shard in any dimension: groups above the first are placed by themselves, groups
#: above the second are split into chunks of at most the third.
OWN, SPLIT, CHUNK = 1 / 64, 1 / 2, 1 / 8
TOKEN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"
LOAD = ("bytes", "tokens", "rows")


def place(units: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Shard of each unit, the largest first; ``units`` are shares of the totals, ``residual`` shrinks by them."""
    out = np.zeros(len(units), dtype=np.int64)
    for i in np.lexsort((np.arange(len(units)), -units.max(axis=1, initial=0))):
        u = units[i]
        fit = (residual >= u - 1e-12).all(axis=1)
        value = residual @ u
        out[i] = np.argmax(np.where(fit, value, -np.inf)) if fit.any() else np.argmax((residual - u).min(axis=1))
        residual[out[i]] -= u
    return out


def _placed(df: DataFrame, key: str, totals: np.ndarray, residual: np.ndarray) -> DataFrame:
    """(key, shard) of the bounded rows of ``df`` (key and loads), placed by their own loads."""
    rows = df.orderBy(key).collect()
    shares = np.array([[r[c] for c in LOAD] for r in rows], dtype=float).reshape(-1, len(LOAD)) / totals
    return df.sparkSession.createDataFrame([(r[key], int(s)) for r, s in zip(rows, place(shares, residual), strict=True)], f"`{key}` string, shard int")


def _classed(groups: DataFrame, totals: np.ndarray, residual: np.ndarray, shards: int) -> DataFrame:
    """(group, loads, shard) of ``groups`` (group, class and loads), by classes."""
    spark = groups.sparkSession
    sums = groups.groupBy("class").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in LOAD]).orderBy("class").collect()  # a row for each class
    small = [r["class"] for r in sums if r["n"] <= SINGLY]
    batches, owners = [], []
    for r in sums:
        if r["n"] > SINGLY:
            share = np.array([r[c] for c in LOAD], dtype=float) / totals
            parts = min(r["n"], max(8 * shards, int(np.ceil(share.max() * shards * PARTS))))
            each = -(-r["n"] // parts)
            for b in range(-(-r["n"] // each)):
                batches.append(share * min(each, r["n"] - b * each) / r["n"])
                owners.append((r["class"], b, each))
    singles = groups.filter(F.col("class").isin(small)) if small else groups.limit(0)
    # both kinds in one descending order: units of their own load, batches of their class's
    rows = singles.orderBy("group").collect()  # at most SINGLY for each class
    units = [np.array([r[c] for c in LOAD], dtype=float) / totals for r in rows] + batches
    where = place(np.array(units).reshape(-1, len(LOAD)), residual)
    of_group = spark.createDataFrame([(r["group"], int(s)) for r, s in zip(rows, where, strict=False)], "group string, shard int")
    of_batch = spark.createDataFrame([(c, b, each, int(s)) for (c, b, each), s in zip(owners, where[len(rows) :], strict=True)], "class string, batch long, each long, shard int")
    large = groups.join(F.broadcast(of_batch.select("class", "each").distinct()), "class")
    ranked = numbered_within(materialise(large), "class", ["group"], "rank", 5_000).withColumn("batch", F.floor(F.col("rank") / F.col("each")))
    by_batch = ranked.join(F.broadcast(of_batch.drop("each")), ["class", "batch"])
    return singles.join(F.broadcast(of_group), "group").select("group", *LOAD, "shard").unionByName(by_batch.select("group", *LOAD, "shard"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs`` (doc_id, text).

    A null text has no bytes and is a group of its own; a group of equal texts stays together unless
    it exceeds half a shard; repeated rows are rows of their group; a null doc_id is a row like any
    other; ties fall by the group's hash; texts of any length are one row; an empty table gives none;
    other columns, whatever their names, are left out.
    """
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("uid"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.regexp_count(text, F.lit(TOKEN)).cast("long").alias("tokens"),
        F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("null")).alias("group"),
    )
    slim = materialise(slim)
    measures = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    totals = np.array([float(x or 1) for x in slim.agg(*measures).first()])
    residual = np.full((shards, len(LOAD)), 1.0 / shards)
    share = F.greatest(*[F.col(c) / F.lit(float(t)) for c, t in zip(LOAD, totals, strict=True)]) * shards
    steps = F.concat_ws(" ", *[F.floor(F.log2(F.col(c) + 1) * k) for c, k in zip(LOAD, (4, 2, 2), strict=True)])
    groups = materialise(slim.groupBy("group").agg(*measures).withColumns({"share": share, "class": steps}))
    chunks = F.when(F.col("share") > SPLIT, F.ceil(F.col("share") / CHUNK)).otherwise(1).cast("int")
    own = groups.filter(F.col("share") > OWN).select("group", chunks.alias("chunks"))  # at most 3 * shards / OWN rows

    # the heavy groups, in chunks
    chunk = F.pmod(F.xxhash64("doc_id", "uid"), F.col("chunks").cast("long"))
    heavy = materialise(slim.join(F.broadcast(own), "group").withColumn("unit", F.concat("group", F.lit(" "), chunk)))
    of_unit = _placed(heavy.groupBy("unit").agg(*measures), "unit", totals, residual)
    columns = ("doc_id", "uid", "size", "text_crc32")
    heavy = heavy.join(F.broadcast(of_unit), "unit").select(*columns, "shard")

    # the others by classes, then the remainder by what the shards hold
    light = groups.filter(F.col("share") <= OWN).withColumn("pool", F.pmod(F.xxhash64("group"), F.lit(POOLS * REMAINDER)))
    done = materialise(_classed(light.filter(F.col("pool") >= POOLS).drop("pool", "share"), totals, residual.copy(), shards))
    for r in done.groupBy("shard").agg(*[F.sum(c).alias(c) for c in LOAD]).collect():
        residual[r["shard"]] -= np.array([r[c] for c in LOAD], dtype=float) / totals
    rest = light.filter(F.col("pool") < POOLS).withColumn("pool", F.col("pool").cast("string"))
    of_pool = _placed(rest.groupBy("pool").agg(*[F.sum(c).alias(c) for c in LOAD]), "pool", totals, residual)
    shard_of = done.select("group", "shard").unionByName(rest.join(F.broadcast(of_pool), "pool").select("group", "shard"))
    placed = slim.join(F.broadcast(own.select("group")), "group", "left_anti").join(shard_of, "group").select(*columns, "shard")

    out = numbered_within(materialise(heavy.unionByName(placed)), "shard", ["doc_id", "uid"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
