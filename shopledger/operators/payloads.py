"""Landed payloads to typed rows: one projection for each source, schemas declared, never inferred."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import cents, count_or_null, duration_seconds, iso_ts, promised_at
from ..sources.scratch import materialise
from .margin import cost_steps, with_unit_cogs
from .quality import require_known

PHOTO = "media_type string, media_product_type string, permalink string, timestamp string, caption string, insights struct<impressions:long,reach:long,likes:long,comments:long,shares:long,saved:long,clicks:long>"
PAGE = (
    "message string, created_time string, permalink_url string, attachments struct<data:array<struct<media_type:string>>>, comments struct<summary:struct<total_count:long>>, "
    "shares struct<count:long>, insights struct<data:array<struct<name:string,period:string,values:array<struct<value:string>>>>>"
)
TEXT = "media_type string, text string, timestamp string, permalink string, insights struct<views:long,likes:long,replies:long,shares:long>"
VIDEO = (
    "snippet struct<title:string,description:string,publishedAt:string,liveBroadcastContent:string>, contentDetails struct<duration:string>, "
    "statistics struct<viewCount:string,likeCount:string,commentCount:string>"
)
REPORT = "columnHeaders array<struct<name:string>>, rows array<array<string>>"
SEARCH = "dimensions array<string>, rows array<struct<keys:array<string>,clicks:double,impressions:double,position:double>>"
ORDER = (
    "created_at string, updated_at string, delivery_date string, status string, subtotal_cents long, discount_cents long, "
    "items array<struct<sku:string,name:string,unit_price_cents:long,quantity:int>>"
)
SHORT_SECONDS, SHORT_TAGGED_SECONDS, MAX_KEY_CHARS = 60, 180, 2000
PACKAGING = "0.50"


def _posts(raw: DataFrame, schema: str) -> DataFrame:
    return raw.withColumn("d", F.from_json("payload", schema))


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0)).cast("long")


def _typed(df: DataFrame, platform: str, kind: Column, at: Column, link: Column, caption: Column, metrics: dict[str, Column], captured_at: datetime) -> DataFrame:
    return df.select(
        F.lit(platform).alias("platform"), "external_id", at.alias("posted_at"), link.alias("permalink"), kind.alias("content_type"), caption.alias("caption"),
        F.lit(captured_at).cast("timestamp").alias("captured_at"), *[v.cast("long").alias(k) for k, v in metrics.items()],
    )


def normalize_photo_posts(raw: DataFrame, captured_at: datetime) -> DataFrame:
    """Photo-network posts (external_id, payload): reels and stories by product, else by media; missing is 0."""
    d, product, media = F.col("d"), F.col("d.media_product_type"), F.col("d.media_type")
    kind = F.when(product == "REELS", "reel").when(product == "STORY", "story").when(media == "CAROUSEL_ALBUM", "carousel").when(media == "VIDEO", "video").when(media == "IMAGE", "image")
    names = {"impressions": "impressions", "reach": "reach", "likes": "likes", "comments": "comments", "shares": "shares", "saves": "saved", "clicks": "clicks"}
    metrics = {k: _zero(d["insights"][v]) for k, v in names.items()}
    return _typed(_posts(raw, PHOTO), "instagram", kind, iso_ts(d["timestamp"]), d["permalink"], d["caption"], metrics, captured_at)


def normalize_page_posts(raw: DataFrame, captured_at: datetime) -> DataFrame:
    """Page posts: the first attachment's type, lifetime figures only, of reactions the likes."""
    d = F.col("d")
    media = F.get(d["attachments"]["data"], F.lit(0))["media_type"]
    kind = F.when(media == "photo", "image").when(media == "video", "video").when(media == "album", "carousel")

    def lifetime(name: str) -> Column:
        found = F.filter(d["insights"]["data"], lambda i: (i["name"] == name) & (i["period"] == "lifetime"))
        return F.get(F.get(found, F.lit(0))["values"], F.lit(0))["value"]

    likes = F.get_json_object(lifetime("post_reactions_by_type_total"), "$.like").try_cast("long")
    metrics = {
        "impressions": _zero(lifetime("post_media_view").try_cast("long")), "reach": _zero(lifetime("post_total_media_view_unique").try_cast("long")), "likes": _zero(likes),
        "comments": _zero(d["comments"]["summary"]["total_count"]), "shares": _zero(d["shares"]["count"]), "saves": F.lit(0), "clicks": _zero(lifetime("post_clicks").try_cast("long")),
    }
    return _typed(_posts(raw, PAGE), "facebook", kind, iso_ts(d["created_time"]), d["permalink_url"], d["message"], metrics, captured_at)


def normalize_text_posts(raw: DataFrame, captured_at: datetime) -> DataFrame:
    """Text-network posts: views are impressions, replies comments; what the network lacks is 0."""
    d, media = F.col("d"), F.col("d.media_type")
    kind = F.when(media == "VIDEO", "video").when(media == "IMAGE", "image").when(media == "CAROUSEL_ALBUM", "carousel")
    i = d["insights"]
    metrics = {"impressions": _zero(i["views"]), "reach": F.lit(0), "likes": _zero(i["likes"]), "comments": _zero(i["replies"]), "shares": _zero(i["shares"]), "saves": F.lit(0), "clicks": F.lit(0)}
    return _typed(_posts(raw, TEXT), "threads", kind, iso_ts(d["timestamp"]), d["permalink"], d["text"], metrics, captured_at)


def normalize_videos(raw: DataFrame, captured_at: datetime, ids: DataFrame | None = None) -> DataFrame:
    """Videos, of ``ids`` (external_id) only if given; a figure that the source leaves out is null, never 0."""
    rows = raw if ids is None else raw.join(ids.select("external_id"), "external_id", "left_semi")
    d = F.col("d")
    snippet, stats = d["snippet"], d["statistics"]
    seconds = duration_seconds(d["contentDetails"]["duration"])
    words = F.lower(F.concat_ws(" ", snippet["title"], snippet["description"]))
    kind = (
        F.when(snippet["liveBroadcastContent"].isin("live", "upcoming"), "video").when(seconds.isNull(), None).when(seconds <= SHORT_SECONDS, "short")
        .when((seconds <= SHORT_TAGGED_SECONDS) & words.contains("#shorts"), "short").otherwise("video")
    )
    link = F.concat(F.when(kind == "short", "https://www.youtube.com/shorts/").otherwise("https://www.youtube.com/watch?v="), "external_id")
    title, text = F.trim(F.coalesce(snippet["title"], F.lit(""))), F.trim(F.coalesce(snippet["description"], F.lit("")))
    caption = F.when(text != "", F.concat(title, F.lit("\n\n"), text)).when(title != "", title)
    none = F.lit(None)
    metrics = {"views": count_or_null(stats["viewCount"]), "likes": count_or_null(stats["likeCount"]), "comments": count_or_null(stats["commentCount"])} | {k: none for k in ("impressions", "reach", "shares", "saves", "clicks")}
    return _typed(_posts(rows, VIDEO), "youtube", kind, iso_ts(snippet["publishedAt"]), link, caption, metrics, captured_at)


def normalize_reports(raw: DataFrame, columns: dict[str, str], fetched_at: datetime) -> DataFrame:
    """Rows of column-header reports by the headers' names, not places; a row of another width is refused.

    ``columns``: report column -> (our name); metrics become whole numbers, null where absent.
    """
    rows = raw.withColumn("d", F.from_json("payload", REPORT)).select("report", F.col("d.columnHeaders.name").alias("names"), F.explode("d.rows").alias("row"))
    same = F.size("names") == F.size("row")
    checked = F.when(same, F.map_from_arrays("names", "row")).otherwise(F.raise_error(F.lit("a report row has another width than its headers")))
    keyed = rows.select("report", checked.alias("r"))
    value = lambda a: F.try_element_at("r", F.lit(a))
    text = {"day", "video", "insightTrafficSourceType"}
    return keyed.select("report", *[(value(a) if a in text else value(a).try_cast("double").cast("long")).alias(b) for a, b in columns.items()], F.lit(fetched_at).cast("timestamp").alias("fetched_at"))


def normalize_search(raw: DataFrame, fetched_at: datetime) -> tuple[DataFrame, DataFrame]:
    """(rows of search reports (report, search_type, payload), one row with the number of rows skipped).

    Keys are named by the report's dimensions; a row whose query and page are too long to index
    is skipped and counted.
    """
    rows = raw.withColumn("d", F.from_json("payload", SEARCH)).select("report", "search_type", F.col("d.dimensions").alias("names"), F.explode("d.rows").alias("x"))
    keyed = rows.select("report", "search_type", F.map_from_arrays("names", F.col("x.keys")).alias("k"), "x")
    part = lambda n: F.try_element_at("k", F.lit(n))
    too_long = F.length(F.coalesce(part("query"), F.lit(""))) + F.length(F.coalesce(part("page"), F.lit(""))) > MAX_KEY_CHARS
    out = keyed.filter(~too_long).select(
        "report", "search_type", part("date").cast("date").alias("day"), *[part(n).alias(n) for n in ("page", "query", "country", "device")],
        F.bround("x.clicks").cast("long").alias("clicks"), F.bround("x.impressions").cast("long").alias("impressions"), F.round("x.position", 3).cast("decimal(8,3)").alias("position"),
        F.lit(fetched_at).cast("timestamp").alias("fetched_at"),
    )
    return out, keyed.agg(F.count(F.when(too_long, 1)).alias("skipped"))


def strict_count(text: Column) -> Column:
    """A whole, non-negative number of a JSON value; anything else raises."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("long")).otherwise(F.raise_error(F.lit("a follower count is not a whole number")).cast("long"))


def normalize_followers(raw: DataFrame) -> DataFrame:
    """Follower captures (platform, captured_at, payload) by local day; a hidden count is null.

    Booleans, fractions, negative numbers and missing fields raise; digits in quotes count only where
    the source writes them so.
    """
    j = lambda path: F.get_json_object("payload", path)
    quoted = F.col("payload").rlike(r'"(followers_count|fan_count)"\s*:\s*"')
    plain = F.when(quoted, F.lit("quoted"))
    count = (
        F.when(F.col("platform") == "instagram", strict_count(F.coalesce(plain, j("$.followers_count"))))
        .when(F.col("platform") == "facebook", strict_count(F.coalesce(plain, j("$.followers_count"), j("$.fan_count"))))
        .when(F.col("platform") == "threads", strict_count(F.get(F.filter(F.from_json(j("$.data"), "array<struct<name:string,total_value:struct<value:string>>>"), lambda x: x["name"] == "followers_count"), F.lit(0))["total_value"]["value"]))
        .when(F.col("platform") == "youtube", F.when(j("$.items[0].statistics.hiddenSubscriberCount") == "true", F.lit(None).cast("long")).otherwise(strict_count(j("$.items[0].statistics.subscriberCount"))))
        .otherwise(F.raise_error(F.lit("unknown platform")).cast("long"))
    )
    day = F.to_date(F.from_utc_timestamp(F.col("captured_at").cast("timestamp"), "Europe/Berlin"))
    return raw.select("platform", day.alias("day"), F.col("captured_at"), count.alias("followers"))


def normalize_orders(raw: DataFrame, menu: DataFrame, recipe: DataFrame, ingredient: DataFrame, channel: str = "direct") -> tuple[DataFrame, DataFrame]:
    """(orders, lines) of landed orders (external_id, payload).

    Each line's cost is that of its dish's recipe when the order was placed. The menu is priced first,
    so that lines cross one join, on their sku. An unknown sku raises. Payloads are read and parsed once
    and written as typed columns, of which the check of skus reads only these.
    """
    d = F.col("d")
    parsed = materialise(raw.select("external_id", F.from_json("payload", ORDER).alias("d")).withColumn("placed_at", iso_ts(d["created_at"])))
    euros = lambda x: (x.cast("decimal(14,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(12,2)")
    nothing = F.lit(0).cast("decimal(12,2)")
    orders = parsed.select(
        F.lit(channel).alias("channel"), "external_id", "placed_at", promised_at(d["delivery_date"].cast("date")).alias("promised_at"),
        F.when(d["status"] == "delivered", iso_ts(d["updated_at"])).alias("delivered_at"), euros(d["subtotal_cents"]).alias("gross"), cents(d["discount_cents"]).alias("discounts"),
        nothing.alias("channel_fee"), F.lit(PACKAGING).cast("decimal(12,2)").alias("packaging_cost"), nothing.alias("delivery_cost"), d["status"].alias("status"),
    )
    lines = parsed.select(F.col("external_id").alias("order_id"), "placed_at", F.posexplode("d.items").alias("at", "item"))
    lines = lines.select("order_id", "placed_at", (F.col("at") + 1).alias("line_no"), F.col("item.sku").alias("slug"), F.col("item.quantity").cast("decimal(10,3)").alias("qty"), euros(F.col("item.unit_price_cents")).alias("unit_price"))
    dishes = menu.select("slug", "item_id").join(cost_steps(recipe, ingredient), "item_id", "left")
    priced = with_unit_cogs(require_known(lines, menu, "slug").join(dishes, "slug"))
    return orders, priced.select("order_id", "line_no", "item_id", "qty", "unit_price", F.col("unit_cogs").cast("decimal(14,4)").alias("unit_cogs_at_time"))


def normalize_events(raw: DataFrame, taxonomy: DataFrame, variants: DataFrame) -> DataFrame:
    """Landed behavioural events with attribution; the source's own ids move into the properties.

    ``raw``: external_id, event_name, occurred_at, source, anonymous_id, session_id, customer_id,
    order_id, properties (map). An unknown name raises; an unknown campaign is null.
    """
    from .attribution import resolve_attribution

    known = require_known(raw, taxonomy, "event_name")
    own = lambda c, n: F.when(F.coalesce(c, F.lit("")) != "", F.create_map(F.lit(n), c)).otherwise(F.create_map().cast("map<string,string>"))
    base = F.coalesce("properties", F.create_map().cast("map<string,string>"))
    base = F.map_filter(base, lambda k, v: ~k.isin("source_customer_id", "source_order_id"))
    merged = F.map_concat(base, own(F.col("customer_id"), "source_customer_id"), own(F.col("order_id"), "source_order_id"))
    rows = known.withColumns({"properties": merged, "utm_source": F.try_element_at("properties", F.lit("utm_source")), "utm_content": F.try_element_at("properties", F.lit("utm_content"))})
    text = F.lit(None).cast("string")
    out = resolve_attribution(rows, variants)
    return out.select("external_id", "event_name", iso_ts(F.col("occurred_at")).alias("occurred_at"), "source", "anonymous_id", "session_id", text.alias("customer_id"), text.alias("order_id"), "channel", "campaign", "variant", F.to_json("properties").alias("properties"))


def converge_reference(base: DataFrame, rows: DataFrame, update: list[str]) -> DataFrame:
    """Reference rows by slug: listed columns follow, those that people own stay."""
    from .merge import merge_update

    return merge_update(base, rows, ["slug"], update)
