"""Posts and their metrics: latest snapshots, windows, detectors, labels, folds."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import caption_length, hashtags, hour_bucket, since
from ..sources.scratch import materialise

MIN_POSTS, DROP = 3, 0.30


def latest_snapshot(snaps: DataFrame) -> DataFrame:
    """The last snapshot of each post, by time and then id; merged before the shuffle."""
    columns = [c for c in snaps.columns if c != "post_id"]
    last = snaps.groupBy("post_id").agg(F.max_by(F.struct(*columns), F.struct("captured_at", "event_id")).alias("s"))
    return last.select("post_id", *[F.col(f"s.{c}").alias(c) for c in columns])


def share_extract(posts: DataFrame, snaps: DataFrame, platforms: list[str]) -> DataFrame:
    """Posts of the shared platforms with their latest figures, unreported ones as 0."""
    figures = latest_snapshot(snaps).select("post_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("likes", "comments", "shares")])
    return posts.filter(F.col("platform").isin(platforms)).join(figures, "post_id").select("post_id", "platform", "content_type", "posted_at", "caption", "likes", "comments", "shares").orderBy("posted_at", "post_id")


def engagement(zero: bool = True) -> Column:
    terms = [F.coalesce(c, F.lit(0)) if zero else F.col(c) for c in ("likes", "comments", "shares")]
    return terms[0] + terms[1] + terms[2]


def engagement_windows(posts: DataFrame, snaps: DataFrame, as_of: datetime) -> DataFrame:
    """Posts and average engagement by platform, over the last and the prior two weeks."""
    recent = posts.filter(since(F.col("posted_at"), 28, as_of)).select("post_id", "platform", F.when(since(F.col("posted_at"), 14, as_of), "recent").otherwise("prior").alias("bucket"))
    joined = recent.join(latest_snapshot(snaps), "post_id").withColumn("engagement", engagement())
    return joined.groupBy("platform", "bucket").agg(F.count("*").alias("post_count"), F.round(F.avg("engagement"), 6).alias("avg_engagement"))


def detect_engagement_drop(windows: DataFrame) -> DataFrame:
    """A verdict for each platform, whether it triggers or not."""
    by = windows.groupBy("platform").agg(*[F.max(F.when(F.col("bucket") == b, F.col(c))).alias(f"{b}_{c}") for b in ("recent", "prior") for c in ("post_count", "avg_engagement")])
    drop = (F.col("prior_avg_engagement") - F.col("recent_avg_engagement")) / F.when(F.col("prior_avg_engagement") > 0, F.col("prior_avg_engagement"))
    enough = (F.col("recent_post_count") >= MIN_POSTS) & (F.col("prior_post_count") >= MIN_POSTS)
    fired = F.coalesce(enough & (drop >= DROP), F.lit(False))
    # The alert's sentences.
    title = F.format_string("%s engagement down %d%% vs. the prior 2 weeks", F.initcap("platform"), F.round(drop * 100).cast("long"))
    detail = F.format_string("Avg engagement/post: %.1f (last 14d, %d posts) vs %.1f (prior 14d, %d posts).", "recent_avg_engagement", "recent_post_count", "prior_avg_engagement", "prior_post_count")
    return by.select(
        F.lit("social-detector").alias("agent"), F.concat(F.lit("social_engagement_drop_"), "platform").alias("alert_key"), fired.alias("triggered"),
        F.when(fired, "warn").alias("severity"), F.when(fired, title).alias("title"), F.when(fired, detail).alias("detail"),
    )


def _places(rows: DataFrame, chunk: Column) -> DataFrame:
    """``rows`` (platform, posted_at, post_id) with ``_c``, the part of time they are in, and ``_n``, their number on the platform so far."""
    dealt = rows.withColumn("_c", chunk)
    sizes = dealt.groupBy("platform", "_c").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy("platform").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1))  # a row for each part of time
    inside = F.row_number().over(Window.partitionBy("platform", "_c").orderBy("posted_at", "post_id"))
    return dealt.join(sizes.select("platform", "_c", F.coalesce(before, F.lit(0)).alias("_before")), ["platform", "_c"]).withColumn("_n", F.col("_before") + inside)


def _value_ranges(rows: DataFrame, block: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(platform, _v, _b) and (platform, _block, _first, _last, _below, _above): buckets of values, and those that a block's medians can be in.

    A block adds ``block`` posts, so its medians have ranks of at least half the earlier posts less a block and at
    most half of all: ``_below`` and ``_above`` count the earlier posts outside the buckets that hold these ranks.
    """
    values = rows.groupBy("platform", "_v").agg(F.count("*").alias("_m"))
    by_value = Window.partitionBy("platform").orderBy("_v")  # a row for each different value
    share = (F.sum("_m").over(by_value.rowsBetween(Window.unboundedPreceding, -1)) * buckets) / F.sum("_m").over(Window.partitionBy("platform"))
    values = materialise(values.select("platform", "_v", F.coalesce(F.floor(share), F.lit(0)).cast("int").alias("_b")))
    held = rows.join(values, ["platform", "_v"]).groupBy("platform", "_block", "_b").agg(F.count("*").alias("_m"))
    every = rows.groupBy("platform").agg(F.max("_block").alias("_most")).select("platform", F.explode(F.sequence(F.lit(0).cast("long"), "_most")).alias("_block"), "_most")
    every = every.select("platform", "_block", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("_b"))
    earlier = Window.partitionBy("platform", "_b").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    before = every.join(held, ["platform", "_block", "_b"], "left").withColumn("_m", F.coalesce(F.sum("_m").over(earlier), F.lit(0)))
    upward = Window.partitionBy("platform", "_block").orderBy("_b")  # a row for each bucket
    before = before.withColumns({"_end": F.sum("_m").over(upward), "_all": F.col("_block") * block})
    low, high = F.expr("_all div 2") - block, F.expr(f"(_all + {block}) div 2") + 1
    inside = ((F.col("_end") >= low) | (low < 1)) & ((F.col("_end") - F.col("_m") < high) | (high > F.col("_all")))
    ranges = before.filter(inside).groupBy("platform", "_block").agg(
        F.min("_b").alias("_first"), F.max("_b").alias("_last"), F.min(F.col("_end") - F.col("_m")).alias("_below"), F.min(F.col("_all") - F.col("_end")).alias("_above")
    )
    return values, materialise(ranges)


def expanding_median(posts: DataFrame, chunks: int = 24, block: int = 1024, buckets: int = 64) -> DataFrame:
    """Each post's median engagement of its platform so far, itself included.

    Posts are numbered along time, from counts by part of a day (``chunks`` a day), and cut into blocks. While
    a block passes, the median can only move by as many ranks as it has posts. So a block gets, from the
    histogram of all earlier blocks, the values within these ranks with their counts, how many lie below
    and above them, and works on that and its own posts alone; no task holds a platform. Posts are told
    apart by post_id.
    """
    rows = posts.select("platform", "posted_at", "post_id", F.col("engagement").alias("_v"))
    placed = _places(rows, F.floor(F.unix_timestamp(F.col("posted_at").cast("timestamp")) * chunks / 86400))
    placed = materialise(placed.select("platform", "posted_at", "post_id", "_v", F.expr(f"(_n - 1) div {block}").alias("_block")))
    values, ranges = _value_ranges(placed, block, buckets)
    wanted = ranges.filter("_block > 0").select("platform", "_block", F.explode(F.sequence("_first", "_last")).alias("_b")).join(values, ["platform", "_b"])
    asked = placed.groupBy("platform", "_v", "_block").agg(F.count("*").alias("_m")).withColumn("_asks", F.lit(False))
    asked = asked.unionByName(wanted.select("platform", "_v", "_block", F.lit(0).cast("long").alias("_m"), F.lit(True).alias("_asks")))
    so_far = Window.partitionBy("platform", "_v").orderBy("_block", F.desc("_asks")).rowsBetween(Window.unboundedPreceding, 0)  # two rows a block at most
    earlier = asked.withColumn("_m", F.sum("_m").over(so_far)).filter("_asks AND _m > 0")
    far = [F.struct(F.col(c).alias("_m"), F.lit(v).alias("_v")) for c, v in (("_below", float("-inf")), ("_above", float("inf")))]
    outside = ranges.select("platform", "_block", F.inline(F.array(*far))).filter("_m > 0")
    own = placed.join(values, ["platform", "_v"]).join(ranges.select("platform", "_block", "_first", "_last"), ["platform", "_block"])
    near = F.when(F.col("_b") < F.col("_first"), float("-inf")).when(F.col("_b") > F.col("_last"), float("inf")).otherwise(F.col("_v").cast("double"))
    nothing = {"posted_at": F.lit(None).cast(posts.schema["posted_at"].dataType), "post_id": F.lit(None).cast(posts.schema["post_id"].dataType)}
    columns = ["platform", "_block", "posted_at", "post_id", "_v", "_m"]
    weighed = own.withColumns({"_v": near, "_m": F.lit(1).cast("long")}).select(*columns)
    weighed = weighed.unionByName(earlier.withColumns({**nothing, "_v": F.col("_v").cast("double")}).select(*columns)).unionByName(outside.withColumns(nothing).select(*columns))
    passing = Window.partitionBy("platform", "_block").orderBy(F.col("post_id").isNotNull(), "posted_at", "post_id").rowsBetween(Window.unboundedPreceding, 0)
    medians = weighed.withColumn("expanding_median", F.percentile("_v", F.lit(0.5), F.col("_m")).over(passing)).filter(F.col("post_id").isNotNull())
    return posts.join(medians.select("post_id", "expanding_median"), "post_id")


def label_posts(posts: DataFrame, snaps: DataFrame, platforms: list[str] | None = None) -> DataFrame:
    """1 where engagement is above the median so far. Posts without a snapshot have no row."""
    known = posts.filter(F.col("platform").isin(platforms)) if platforms else posts
    base = known.join(latest_snapshot(snaps).withColumn("engagement", engagement()).select("post_id", "engagement"), "post_id")
    return expanding_median(base).withColumn("label", F.when(F.col("engagement") > F.col("expanding_median"), 1).otherwise(0))


def class_balance(labeled: DataFrame) -> DataFrame:
    """Rows and positives by platform and, with a null platform, of all."""
    return labeled.rollup("platform").agg(F.count("*").alias("n"), F.sum("label").alias("positives"), F.round(F.avg("label"), 6).alias("positive_rate"))


def temporal_split(df: DataFrame, cutoff: datetime) -> DataFrame:
    at = F.lit(cutoff).cast("timestamp_ntz")
    return df.withColumn("split", F.when(F.col("posted_at") > at, "test").otherwise("train"))


def expanding_folds(df: DataFrame, n_splits: int = 5, chunks: int = 24) -> DataFrame:
    """Fold of each row in time order: 0 for the first block, which is never tested, then 1 .. n_splits.

    Blocks have n // (n_splits + 1) rows, the first also what is left over. A row's place comes from
    counts by part of a day and a numbering within the part, so no partition holds a day.
    """
    part = F.floor((F.unix_timestamp(F.col("posted_at").cast("timestamp")) % 86400) * chunks / 86400).cast("int")
    dealt = df.withColumns({"_day": F.to_date("posted_at"), "_part": part})
    days = dealt.groupBy("_day", "_part").agg(F.count("*").alias("_n"))
    ordered = Window.orderBy("_day", "_part")
    before = F.coalesce(F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    days = days.select("_day", "_part", before.alias("_before"), total.alias("_total"))  # a row for each part of a day
    inside = F.row_number().over(Window.partitionBy("_day", "_part").orderBy("posted_at", "post_id"))
    ranked = dealt.join(F.broadcast(days), ["_day", "_part"]).withColumn("_at", F.col("_before") + inside - 1)
    block = F.floor(F.col("_total") / (n_splits + 1))
    first = F.col("_total") - block * n_splits
    fold = F.when(F.col("_at") < first, 0).otherwise(1 + F.floor((F.col("_at") - first) / F.greatest(block, F.lit(1))))
    return ranked.withColumn("fold", fold.cast("int")).drop("_day", "_part", "_before", "_total", "_at")


def build_features(posts: DataFrame) -> DataFrame:
    """What is known of a post before it is out; no metric is among it."""
    kind = F.coalesce("content_type", F.lit("unknown"))
    return posts.select(
        "post_id", "platform", "posted_at", kind.alias("content_type"), kind.isin("video", "reel").cast("int").alias("is_video"),
        F.date_format("posted_at", "EEEE").alias("day_of_week"), hour_bucket(F.col("posted_at")).alias("hour_bucket"),
        caption_length(F.col("caption")).alias("caption_length"), hashtags(F.col("caption")).cast("int").alias("hashtag_count"),
        *[c for c in ("label", "engagement") if c in posts.columns],
    )


def split_leakage(train: DataFrame, test: DataFrame) -> DataFrame:
    """Shared ids, test rows with a training caption, and whether time overlaps."""
    ids = train.select("post_id").intersect(test.select("post_id")).agg(F.count("*").alias("shared_ids"))
    texts = test.join(train.select("caption").distinct(), "caption", "left_semi").agg(F.count("*").alias("shared_captions"))
    times = train.agg(F.max("posted_at").alias("a")).crossJoin(test.agg(F.min("posted_at").alias("b"))).select((F.col("a") < F.col("b")).alias("in_order"))
    return ids.crossJoin(texts).crossJoin(times)  # three rows of one


def fanout_check(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of the spine and of its join, and keys that the right side has twice."""
    twice = right.groupBy(key).count().filter("count > 1").agg(F.count("*").alias("duplicate_keys"))
    spine = left.agg(F.count("*").alias("spine_rows"))
    joined = left.select(key).join(right.groupBy(key).agg(F.count("*").alias("n")), key).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("joined_rows"))
    return spine.crossJoin(joined).crossJoin(twice)  # three rows of one
