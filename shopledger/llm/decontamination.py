"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every ``WINDOW`` neighbouring k-gram hashes the least is kept, in documents and items alike. A span
of k + WINDOW - 1 words that both hold has the same least hash in both, so any shared span of that
length joins; k and WINDOW are set so that it is the contract's ten words. Hits are then
extended: in the documents that joined, every run of ten words is compared with the items'. An item of
fewer words is a single window; documents are searched for the hashes of these in the same pass,
without a row for each run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialise

SPAN, K = 10, 6
WINDOW = SPAN - K + 1
#: Fixed value: what separates words once A-Z are lower-cased.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fingerprints up to this many are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Short windows of one length that are looked up in place; of more, every run is joined.
IN_PLACE = 5_000
#: Stands for a short window among the fingerprints; whoever has it by chance is only looked at closer.
SHORT = 0


def words(text: Column) -> Column:
    """Lower-cased words; a null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATOR), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, though a lambda inside reads it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(n: Column, span: int) -> Column:
    """0 .. n - span, none if that is negative."""
    return F.when(n >= span, F.sequence(F.lit(0), n - span)).otherwise(F.array().cast("array<int>"))


def winnowed(w: Column) -> Column:
    """Distinct least hashes of the k-grams of each window."""
    def grams(h: Column) -> Column:
        return F.transform(_starts(F.size(h), K), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(K)]))

    def least(g: Column) -> Column:
        return F.transform(_starts(F.size(g), WINDOW), lambda i: F.array_min(F.slice(g, i + 1, WINDOW)))

    return F.array_distinct(_let(_let(F.transform(w, lambda x: F.xxhash64(x)), grams), least))


def _holds(w: Column, hashes: dict[int, list[int]]) -> Column:
    """Whether any run of a span's length has one of the span's hashes."""
    def any_of(h: Column) -> Column:
        return reduce(Column.__or__, [F.exists(_starts(F.size(h), span), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(span)]).isin(found)) for span, found in hashes.items()])  # noqa: B023

    return _let(F.transform(w, lambda x: F.xxhash64(x)), any_of)


def _runs(w: Column, span: int) -> Column:
    def of(v: Column) -> Column:
        return F.transform(_starts(F.size(v), span), lambda i: F.struct(i.alias("start"), F.array_join(F.slice(v, i + 1, span), " ").alias("run")))

    return _let(w, of)


def _bounded(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def decontaminate(docs: DataFrame, benchmark: DataFrame, *keep: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs``.

    ``keep`` names columns of ``docs`` that come along. A null or wordless text hits nothing, and an
    item without words has no window; the digest of no items is that of the empty string. Equal
    windows of several items count for each, repeated items once; repeated documents give repeated
    rows; a null doc_id is a row like any other; texts of any length are read whole; columns beside
    doc_id, text and those to keep are left out, whatever their names; empty tables give none or no hits.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    items = materialise(items.withColumn("span", F.least(F.size("w"), F.lit(SPAN))))
    windows = items.select("item", "span", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - F.col("span")), lambda i: F.array_join(F.slice("w", i + 1, F.col("span")), " "))).alias("run"))
    windows = materialise(windows.distinct())
    prints = items.filter(F.col("span") == SPAN).select(F.explode(winnowed(F.col("w"))).alias("print")).distinct()
    spans = sorted(r[0] for r in items.select("span").distinct().collect())  # ten values at most

    texts = docs.select("text").filter(F.col("text").isNotNull())
    keyed = texts.select(F.xxhash64("text").alias("t1"), F.hash("text").alias("t2"), words(F.col("text")).alias("w"))
    short, crowded = {}, []
    for span in (x for x in spans if x < SPAN):
        own_hash = F.xxhash64(*[F.xxhash64(F.split("run", " ")[j]) for j in range(span)])
        found = windows.filter(F.col("span") == span).select(own_hash.alias("h")).distinct().limit(IN_PLACE + 1).collect()
        if len(found) <= IN_PLACE:
            short[span] = [r["h"] for r in found]
        else:
            crowded.append(span)
    candidates = None
    if short or spans and spans[-1] == SPAN:
        kept = winnowed(F.col("w"))
        if short:
            kept = F.concat(kept, F.when(_holds(F.col("w"), short), F.array(F.lit(SHORT).cast("long"))).otherwise(F.array().cast("array<long>")))
            prints = prints.unionByName(spark.range(1).select(F.lit(SHORT).cast("long").alias("print")))
        candidates = keyed.select("t1", "t2", F.explode(kept).alias("print")).join(_bounded(prints), "print", "left_semi").select("t1", "t2")
    for span in crowded:
        runs = keyed.select("t1", "t2", F.explode(_runs(F.col("w"), span)).alias("r")).select("t1", "t2", F.col("r.run").alias("run"))
        some = runs.join(_bounded(windows.filter(F.col("span") == span).select("run").distinct()), "run", "left_semi").select("t1", "t2")
        candidates = some if candidates is None else candidates.unionByName(some)
    own = ("_t1", "_t2")
    base = docs.select("doc_id", *keep, F.xxhash64("text").alias(own[0]), F.hash("text").alias(own[1]), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    empty = F.sha2(F.lit(""), 256)
    if candidates is None:
        found = base.select("*", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), empty.alias("items_sha256"))
    else:
        candidates = materialise(candidates.distinct())
        few = docs.select("text").filter(F.col("text").isNotNull()).withColumns({"t1": F.xxhash64("text"), "t2": F.hash("text")})
        few = few.join(_bounded(candidates), ["t1", "t2"], "left_semi").groupBy("t1", "t2").agg(F.first("text").alias("text"))
        few = materialise(few).select("t1", "t2", words(F.col("text")).alias("w"))
        runs = None
        for span in spans:
            some = few.select("t1", "t2", F.explode(_runs(F.col("w"), span)).alias("r")).select("t1", "t2", F.lit(span).alias("span"), "r.start", "r.run")
            runs = some if runs is None else runs.unionByName(some)
        hits = materialise(runs.join(_bounded(windows.select("span", "run").distinct()), ["span", "run"], "left_semi"))
        places = hits.select("t1", "t2", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("span") - 1)).alias("place"))
        n_hit = places.distinct().groupBy("t1", "t2").agg(F.count("*").alias("n_hit"))
        of_items = hits.select("t1", "t2", "span", "run").distinct().join(_bounded(windows), ["span", "run"]).select("t1", "t2", "item").distinct()
        named = of_items.groupBy("t1", "t2").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256"))
        by_text = materialise(n_hit.join(named, ["t1", "t2"])).withColumnsRenamed({"t1": own[0], "t2": own[1]})
        found = base.join(_bounded(by_text), list(own), "left").withColumns(
            {"n_hit": F.coalesce("n_hit", F.lit(0)), "n_items": F.coalesce("n_items", F.lit(0)), "items_sha256": F.coalesce("items_sha256", empty)}
        )
    return found.withColumn("contaminated", F.col("n_hit") > 0).select("doc_id", *keep, "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage; all columns stay, whatever their names."""
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    return decontaminate(whole, benchmark, "whole").filter(~F.col("contaminated")).select("whole.*")


#: The contract in SQL. Candidates are found by whole windows.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, span, array_to_string(w[s:s + span - 1], ' ') AS run
  FROM (SELECT item, w, least(len(w), 10) AS span, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)),
runs AS (
  SELECT r, span, s, array_to_string(w[s:s + span - 1], ' ') AS run
  FROM (SELECT d.r, d.w, k.span, unnest(range(1, CAST(len(d.w) - k.span + 2 AS BIGINT))) AS s FROM d CROSS JOIN (SELECT DISTINCT span FROM win) k WHERE len(d.w) >= k.span)),
hit AS (SELECT runs.r, runs.span, runs.s, win.item FROM runs JOIN win ON runs.span = win.span AND runs.run = win.run),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + span)) AS p FROM hit) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items,
  coalesce(m.items_sha256, sha256('')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.r = n.r LEFT JOIN m ON d.r = m.r
"""
