"""Near-copies of whole texts: groups by the Jaccard similarity of their word shingles.

Candidates come from two searches. The fingerprints are linked by their pivot distance table, as in
``simhash``: it loses none within two bits. Texts at a similarity of 0.8 differ in about ten of 64
bits, where no cell of pivot coordinates is sure; so what lies beyond comes from bands of least shingle
hashes, of which the distances to pivots discard. Those of 25 bands of five least hashes find a pair at
0.8 but for about 0.67 ** 25, one in 20,000. The exact similarity of the shingle sets decides, for both
in one pass.

Small buckets of a band are paired. In the large ones every text is compared with one other of each;
the texts of buckets that still hold several groups are joined on their rarest shingles, first by one
pair for each shingle, then, between what are still different groups, by all pairs of a prefix filter
with lengths and positions, which is exact and meets a template that many share only in texts that
are alike but for less than the similarity allows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, unused
from .simhash import bit_counts, components, coordinates, distance, fingerprint_links, shingle_hashes

#: Permutations of the sketch; bands and their least hashes; pairs made of a bucket's texts up to so
#: many; bits within which fingerprints of similar texts stay (about 10 expected, deviation 3).
SKETCH, BANDS, ROWS, PAIR_UP_TO, SIMILAR_BITS = 128, 25, 5, 8, 22
#: Bits within which the pivot distance table finds every pair of fingerprints.
PIVOT_BITS = 2
#: The sketch only discards: pairs whose estimate is four standard errors below the similarity.
ERRORS = 4
#: Rows of up to 16 bytes that go to all tasks at most; beyond, the join shuffles.
BROADCAST_ROWS = 500_000
_FACTORS = np.random.default_rng(5).integers(1, 2**63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    parts = [np.unique(hashes) for hashes in shingle_hashes(text, size)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def profile(text: str | None, size: int) -> tuple[int, int, list[int], bytes]:
    """(key of the shingle set, fingerprint, bands, sketch) of a text; signed longs.

    The sketch keeps the low byte of each least hash: the high ones are near zero in long texts.
    """
    counts, n = np.zeros(64, dtype=np.int64), 0
    least = np.full(SKETCH, np.iinfo(np.uint64).max, dtype=np.uint64)
    distinct: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        for hashes in shingle_hashes(text, size):
            counts += bit_counts(hashes)
            n += len(hashes)
            own = np.unique(hashes)
            distinct.append(own)
            for at in range(0, len(own), 4096):
                least = np.minimum(least, (own[at : at + 4096, None] * _FACTORS).min(axis=0))
        every = np.unique(np.concatenate(distinct)) if len(distinct) > 1 else distinct[0] if distinct else np.zeros(0, np.uint64)
        key = every.sum(dtype=np.uint64) ^ (np.bitwise_xor.reduce(every, initial=np.uint64(0)) * _FACTORS[0]) if len(every) else np.uint64(0)
        bands = np.arange(BANDS, dtype=np.uint64) * _FACTORS[1]
        for j in range(ROWS):
            bands = (bands ^ (bands >> np.uint64(29)) ^ least[j : BANDS * ROWS : ROWS]) * _FACTORS[2 + j]
    fp = np.uint64(sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist()))
    return int(key.astype(np.int64)), int(fp.astype(np.int64)), bands.astype(np.int64).tolist(), (least & np.uint64(0xFF)).astype(np.uint8).tobytes()


def sketch_similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of the rows of two tables of sketches; bytes agree by chance in 1 of 256."""
    return ((a == b).mean(axis=1) - 1 / 256) / (1 - 1 / 256)


def _few(df: DataFrame) -> DataFrame:
    """``df`` (written, a few longs a row) marked for broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _profiles(docs: DataFrame, size: int) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                some = batch.slice(at, 1000)
                rows = [profile(t.as_py(), size) for t in some.column(2)]
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names=["doc_id", "copy", "node", "fp", "bands", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("copy"), "text").mapInArrow(of, "doc_id long, copy long, node long, fp long, bands array<long>, sketch binary")


def _shingle_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node and its distinct shingles of each row of ``nodes`` (node, copy), made anew from the texts."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                some = batch.slice(at, 1000)
                sets = [shingle_set(t.as_py(), size).view(np.int64) for t in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    wanted = _few(materialise(nodes.select("node", "copy")))
    texts = docs.select(F.xxhash64("text").alias("copy"), "text").join(wanted, "copy").dropDuplicates(["node"])
    return materialise(texts.select("node", "text").mapInArrow(of, "node long, shingles array<long>"))


def _bucket_pairs(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs a < b of small buckets; key, node of the large ones)."""
    keyed = nodes.filter("node <> 0").select("node", F.explode("bands").alias("key"))
    sizes = materialise(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).filter("n > 1"))
    shared = materialise(keyed.join(_few(sizes), "key"))
    small = shared.filter(F.col("n") <= PAIR_UP_TO)
    pairs = small.select("key", F.col("node").alias("a")).join(small.select("key", F.col("node").alias("b")), "key").filter("a < b").select("a", "b")
    return materialise(pairs.distinct()), shared.filter(F.col("n") > PAIR_UP_TO).select("key", "node")


def _parted(large: DataFrame, roots: DataFrame | None) -> DataFrame:
    """key, node, root, and of its bucket n and the least node, of the buckets that hold several groups."""
    rooted = large.withColumn("root", F.col("node")) if roots is None else large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = rooted.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("key", "n", "least")
    return materialise(rooted.join(split, "key").select("key", "node", "root", "n", "least"))


def _stars(parted: DataFrame) -> DataFrame:
    """Pairs a < b of each node: with the least of all its buckets, and with some node of each.

    A bucket is dealt into parts of about ``PAIR_UP_TO`` nodes, and the members of a part are paired with
    the one that comes first by a hash.
    """
    part = F.pmod(F.xxhash64("node", F.lit(0)), F.ceil(F.col("n") / PAIR_UP_TO))
    rows = parted.withColumn("part", part)
    middle = rows.groupBy("key", "part").agg(F.min(F.struct(F.xxhash64("node", "key").alias("h"), "node", "root")).alias("hub")).select("key", "part", F.col("hub.node").alias("hub"), F.col("hub.root").alias("other"))
    some = rows.join(middle, ["key", "part"]).filter("root <> other").select("node", "hub")
    least = parted.groupBy("node").agg(F.min("least").alias("hub")).filter("node <> hub")
    return some.unionByName(least).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """node, n, shingle, at: the first shingles of each set (node, shingles) and their places, written.

    With all shingles in one order, the rarest first,
    two sets of n <= m shingles that share s / (1 + s) * (n + m) have one in common among the first
    n - 2 s / (1 + s) n + 1 of the one and m - s m + 1 of the other, and behind their first common one
    at least the rest of what they share. Shingles of a single set come first and need no join.
    """
    each = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    held = each.groupBy("shingle").agg(F.count("*").alias("texts")).filter("texts > 1")
    shared = each.join(held, "shingle").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("texts", "shingle"))).alias("all"))
    longest = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1
    placed = shared.select("node", "n", F.posexplode("all").alias("i", "x"), (F.col("n") - F.size("all")).alias("alone"))
    return materialise(placed.select("node", "n", F.col("x.shingle").alias("shingle"), (F.col("alone") + F.col("i") + 1).alias("at")).filter(F.col("at") <= longest))


def _prefix_stars(prefixes: DataFrame, groups: DataFrame) -> DataFrame:
    """A pair a < b for each node and shingle of ``prefixes``: with one that shares it, if of another group."""
    rows = prefixes.join(groups, "node")
    hubs = rows.groupBy("shingle").agg(F.min(F.struct(F.xxhash64("node", "shingle").alias("h"), "node", "root")).alias("hub"))
    met = rows.join(hubs, "shingle").filter("root <> hub.root")
    return met.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()


def _prefix_pairs(prefixes: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """Pairs a < b of different groups (node, root) that may be as alike as ``similarity``; none that are is missing."""
    placed = prefixes.join(groups, "node")
    both = 2 * similarity / (1 + similarity)
    index = placed.filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * both - 1e-9) + 1)
    x = index.select("shingle", *[F.col(c).alias(f"{c}1") for c in ("node", "n", "at", "root")])
    y = placed.select("shingle", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "at", "root")])
    needed = F.ceil((F.col("n1") + F.col("n2")) * (both / 2) - 1e-9)
    possible = 1 + F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2"))
    met = x.join(y, "shingle").filter("node1 <> node2 AND root1 <> root2 AND n1 <= n2").filter(F.col("n1") >= F.col("n2") * similarity - 1e-9).filter(possible >= needed)
    return met.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()


def _with_sides(pairs: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """Pairs (a, b) with the column of both nodes, as ``column``_a and ``column``_b."""
    for side in "ba":
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col(column).alias(f"{column}_{side}")), side)
    return pairs.select("a", "b", f"{column}_a", f"{column}_b")


def _within(a: Column, b: Column, radius: int) -> Column:
    """Whether no distance to a pivot differs by more than ``radius``."""
    steps = [[p - q for p, q in zip(x, y, strict=True)] for x, y in zip(coordinates(a), coordinates(b), strict=True)]
    return reduce(Column.__and__, [F.abs(reduce(Column.__add__, some)) <= radius for some in zip(*steps, strict=True)])


def _alike(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs whose shingle sets have a Jaccard similarity of at least ``similarity``.

    Distances to pivots, fingerprints and sketches discard; the sets of what is left decide.
    """
    near = _with_sides(pairs, nodes, "fp")
    near = near.filter(_within(F.col("fp_a"), F.col("fp_b"), SIMILAR_BITS)).filter(distance(F.col("fp_a"), F.col("fp_b")) <= SIMILAR_BITS)
    near = _with_sides(materialise(near.select("a", "b")), nodes, "sketch")  # only survivors carry sketches through a shuffle
    least = similarity - ERRORS * (similarity * (1 - similarity) / SKETCH) ** 0.5

    def may_be(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            a, b = (np.frombuffer(b"".join(f[c]), dtype=np.uint8).reshape(-1, SKETCH) for c in ("sketch_a", "sketch_b"))
            yield f.loc[sketch_similarity(a, b) >= least, ["a", "b"]]

    def are(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    near = materialise(near.mapInPandas(may_be, "a long, b long"))
    wanted = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
    sets = _shingle_sets(docs, nodes.select("node", "copy").join(wanted, "node", "left_semi"), size)
    return materialise(_with_sides(near, sets, "shingles").mapInArrow(are, "a long, b long"))


def _grouped(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """doc_id, copy (a hash of the text) and ``keeper`` (struct of both) of each row."""
    rows = materialise(_profiles(docs, size))
    own = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "copy")
    nodes = rows.groupBy("node").agg(F.min(own).alias("first"), *[F.first(c).alias(c) for c in ("copy", "fp", "bands", "sketch")])
    nodes = materialise(nodes)
    pairs, large = _bucket_pairs(nodes)
    pairs = materialise(pairs.unionByName(_stars(_parted(large, None))).distinct())
    links = _alike(pairs, nodes, docs, size, similarity)
    roots = components(links)
    parted = _parted(large, roots)
    prefixes = None
    for last in (False, True):  # most groups meet by one pair a shingle, so that few pairs are left for the whole join
        groups = materialise(parted.select("node", "root").distinct())
        if not groups.limit(1).count():
            break
        if prefixes is None:
            prefixes = _prefixes(_shingle_sets(docs, nodes.select("node", "copy").join(groups, "node", "left_semi"), size), similarity)
        more = _prefix_pairs(prefixes, groups, similarity) if last else _prefix_stars(prefixes, groups)
        more = materialise(more.join(pairs, ["a", "b"], "left_anti"))
        if more.limit(1).count():
            pairs = materialise(pairs.unionByName(more))
            links = materialise(links.unionByName(_alike(more, nodes, docs, size, similarity)))
            roots = components(links)
            parted = parted if last else _parted(large, roots)
    named = nodes.select("node", "first").join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    keepers = named.groupBy("root").agg(F.min("first").alias("keeper"))
    keepers = named.join(keepers, "root").select("node", "keeper")
    return rows.select("doc_id", "copy", "node").join(keepers, "node").select("doc_id", "copy", "keeper")


def representatives(links: DataFrame, ranks: DataFrame) -> DataFrame:
    """(node, keeper) of the nodes that go: each has a link to its keeper, and no two that stay have one.

    ``links``: pairs (a, b); ``ranks``: (node, rank) of all their nodes. Least rank first, equal ranks by
    node: in each round a node that is before all its undecided neighbours stays, and these go.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct()
    for side in "uv":
        both = both.join(ranks.select(F.col("node").alias(side), F.struct("rank", F.col("node").alias("id")).alias(f"{side}_at")), side)
    open_, gone = materialise(both), None
    while True:
        stays = materialise(open_.groupBy("u").agg(F.max(F.col("v_at") < F.col("u_at")).alias("waits")).filter("NOT waits").select(F.col("u").alias("v")))
        if not stays.limit(1).count():
            break
        went = materialise(open_.join(stays, "v").groupBy("u").agg(F.min("v_at").alias("at")).select("u", F.col("at.id").alias("keeper")))
        gone = went if gone is None else gone.unionByName(went)
        decided = stays.unionByName(went.select(F.col("u").alias("v")))
        open_ = materialise(open_.join(decided, "v", "left_anti").join(decided.withColumnRenamed("v", "u"), "u", "left_anti"))
    if gone is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("keeper")).limit(0)
    return materialise(gone.withColumnRenamed("u", "node"))


def _left_in_buckets(large: DataFrame, nodes: DataFrame, gone: DataFrame | None) -> DataFrame:
    """key, node, at (rank and node), and of its bucket n and the first ``at``: those that stay, of buckets where several do."""
    rows = (large if gone is None else large.join(gone.select("node"), "node", "left_anti")).join(nodes.select("node", F.struct("rank", "node").alias("at")), "node")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("at").alias("least")).filter("n > 1")
    return materialise(rows.join(sizes, "key"))


def _hub_pairs(left: DataFrame, turn: int) -> DataFrame:
    """Pairs a < b of each node with the first of all its buckets, and with the first of a part of each, of about ``PAIR_UP_TO`` nodes."""
    rows = left.withColumn("part", F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("n") / PAIR_UP_TO)))
    hubs = rows.groupBy("key", "part").agg(F.min("at").alias("hub"))
    some = rows.join(hubs, ["key", "part"]).select("node", F.col("hub.node").alias("hub"))
    least = left.groupBy("node").agg(F.min("least").alias("hub")).select("node", F.col("hub.node").alias("hub"))
    return some.unionByName(least).filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _pivot_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs a < b of nodes whose fingerprints the pivot distance table links.

    Nodes of one fingerprint meet the first of them, which stands for them in links to others.
    """
    rows = nodes.filter("node <> 0").select("fp", "node", "rank")
    firsts = materialise(rows.groupBy("fp").agg(F.min(F.struct("rank", "node")).alias("at")).select("fp", F.col("at.node").alias("hub")))
    same = rows.join(firsts, "fp").filter("node <> hub").select("node", "hub")
    links = fingerprint_links(firsts.select("fp"), PIVOT_BITS)
    for side in "ab":
        links = links.join(firsts.select(F.col("fp").alias(side), F.col("hub").alias(f"hub_{side}")), side)
    pairs = same.unionByName(links.select(F.col("hub_a").alias("node"), F.col("hub_b").alias("hub")))
    return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _represented(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """doc_id, copy (a hash of the text) and ``keeper`` (struct of both) of each row."""
    rows = materialise(_profiles(docs, size))
    own = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "copy")
    nodes = rows.groupBy("node").agg(F.min(own).alias("first"), *[F.first(c).alias(c) for c in ("copy", "fp", "bands", "sketch")])
    nodes = materialise(nodes.withColumn("rank", F.coalesce("first.doc_id", F.lit((1 << 63) - 1))))
    beyond, large = _bucket_pairs(nodes)
    large = materialise(large)
    hubs = _hub_pairs(_left_in_buckets(large, nodes, None), 0)
    tried = materialise(_pivot_pairs(nodes).unionByName(beyond).unionByName(hubs).distinct())  # judged at once: each pass is some twenty jobs
    links = _alike(tried, nodes, docs, size, similarity)
    gone = representatives(links, nodes)
    prefixes, placed, turn = None, None, 1
    while True:
        left = _left_in_buckets(large, nodes, gone)
        if not left.limit(1).count():
            break
        here = materialise(left.select("node", F.col("node").alias("root")).distinct())
        if turn < 2:  # most copies meet the first of a part of their bucket
            more = _hub_pairs(left, turn)
        else:
            if placed is None or here.join(placed, "node", "left_anti").limit(1).count():  # also where a text stays after all
                placed = here.select("node")
                prefixes = _prefixes(_shingle_sets(docs, nodes.select("node", "copy").join(placed, "node", "left_semi"), size), similarity)
            more = _prefix_stars(prefixes, here) if turn == 2 else _prefix_pairs(prefixes, here, similarity)
        more = materialise(more.join(tried, ["a", "b"], "left_anti"))
        found = more.limit(1).count() > 0
        if found:
            tried = materialise(tried.unionByName(more))
            fresh = _alike(more, nodes, docs, size, similarity)
            if fresh.limit(1).count():
                links = materialise(links.unionByName(fresh))
                gone = representatives(links, nodes)
            elif turn > 2:
                break  # all that stay were compared, and none are alike
        elif turn > 2:
            break
        turn += 1
    keepers = gone.join(nodes.select(F.col("node").alias("keeper"), F.col("first").alias("named")), "keeper").select("node", "named")
    keepers = nodes.select("node", "first").join(keepers, "node", "left").select("node", F.coalesce("named", "first").alias("keeper"))
    return rows.select("doc_id", "copy", "node").join(keepers, "node").select("doc_id", "copy", "keeper")


def similar_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id and keeper of each row: the least doc_id of its group.

    A group is what links of at least ``similarity`` reach, so a text may be less like its keeper than
    like a text between. Texts of one shingle set are one node; those without words, or null, are one
    group; repeated rows give repeated results; a null doc_id is kept only of a group without any other;
    an empty table gives no rows; other columns, whatever their names, are left out.
    """
    return _grouped(docs, size, similarity).select("doc_id", F.col("keeper.doc_id").alias("keeper"))


def kept_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id and keeper of each row: itself, or a text that stays and is at least as similar as ``similarity``.

    No two keepers are so similar, but for what the candidate search misses. Rows are judged as in
    ``similar_groups``, whose groups may be wider: there a text between joins two that are less alike.
    """
    return _represented(docs, size, similarity).select("doc_id", F.col("keeper.doc_id").alias("keeper"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without the texts that are near-copies of one that stays, as in ``kept_copies``; lower doc_ids stay.

    A row is known by its doc_id and text: of rows with one doc_id and different texts each is judged
    by itself, of rows equal in both one stays; a row without a doc_id stays if nothing that stays is like
    it. All columns stay as they are, whatever their names; an empty table stays empty.
    """
    grouped = materialise(_represented(docs, size, similarity))
    kept = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("copy") == F.col("keeper.copy"))
    gone = _few(materialise(grouped.filter(~kept).select(F.struct("doc_id", "copy").alias(unused(docs, "gone"))).distinct()))
    key = F.col(gone.columns[0])
    left = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(key["doc_id"]) & (F.xxhash64("text") == key["copy"]), "left_anti")
    repeated = grouped.filter(kept).groupBy("doc_id", "copy").count().filter("count > 1").limit(1).count()
    return left.dropDuplicates(["doc_id", "text"]) if repeated else left
