"""Every registered query by name, and the SQL it is compared with.

Queries read the given tables through ``Store``; the SQL names the same views.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as x
from ..operators import alerts, attribution, margin, merge, payloads, privacy, quality, reports, social, web
from ..sources import readers
from ..sources.views import Store, with_views
from . import oracle

AS_OF = datetime(1998, 6, 15)
POSTS_AS_OF = datetime(2024, 1, 30, 12)
PLATFORMS = ["src0", "src1", "src2"]
SALT = b"a salt of the tests"
SINCE = "2024-01-08"
CUTOFF = datetime(2024, 1, 22)

_QUERIES: dict[str, Callable[[Store], DataFrame]] = {}


def query(f: Callable[[Store], DataFrame]) -> Callable[[Store], DataFrame]:
    _QUERIES[f.__name__] = f
    return f


# margin and cost


@query
def true_margin(s: Store) -> DataFrame:
    return margin.true_margin(s.f_orders, s.f_order_line, AS_OF)


@query
def order_cogs(s: Store) -> DataFrame:
    return margin.order_cogs(s.f_order_line).select("order_id", x.as_double(F.col("cogs"), 4).alias("cogs"))


@query
def unit_cogs_at(s: Store) -> DataFrame:
    lines = s.f_order_line.join(s.f_orders.select("order_id", "placed_at"), "order_id").select("order_id", "line_no", "item_id", "placed_at")
    return margin.unit_cogs_at(lines, s.f_recipe, s.f_ingredient).select("order_id", "line_no", x.as_double(F.col("unit_cogs"), 4).alias("unit_cogs"))


@query
def dish_margin(s: Store) -> DataFrame:
    return margin.dish_margin(s.f_menu_item, s.f_recipe, s.f_ingredient)


@query
def recipe_breakdown(s: Store) -> DataFrame:
    return margin.recipe_breakdown(s.f_menu_item, s.f_recipe, s.f_ingredient, "part_7")


@query
def zero_cogs_lines(s: Store) -> DataFrame:
    return margin.zero_cogs_lines(s.f_orders, s.f_order_line, s.f_menu_item)


@query
def zero_cogs_count(s: Store) -> DataFrame:
    return margin.zero_cogs_count(s.f_orders, s.f_order_line)


@query
def ad_efficiency(s: Store) -> DataFrame:
    return margin.ad_efficiency(s.f_ad_spend, AS_OF)


@query
def recent_orders(s: Store) -> DataFrame:
    return margin.recent_orders(s.f_orders, s.f_order_line, s.f_menu_item)


# reports


@query
def table_counts(s: Store) -> DataFrame:
    return reports.table_counts({n: s.table(n) for n in ("orders", "lineitem", "part", "supplier", "events", "pages", "documents")})


@query
def repeat_customers(s: Store) -> DataFrame:
    return reports.repeat_customers(s.f_orders)


@query
def review_queue(s: Store) -> DataFrame:
    return reports.review_queue(s.f_review)


@query
def ingredient_suppliers(s: Store) -> DataFrame:
    return reports.ingredient_suppliers(s.f_ingredient, s.nation.select(F.col("n_nationkey").alias("supplier_id"), F.col("n_name").alias("name")))


@query
def supplier_ranking(s: Store) -> DataFrame:
    score = F.when(F.col("s_suppkey") % 5 != 0, F.round("s_acctbal", 2))
    return reports.supplier_ranking(s.supplier.select(F.lower("s_name").alias("slug"), score.alias("reliability_score")), "reliability_score")


@query
def menu_by_price(s: Store) -> DataFrame:
    return reports.menu_by_price(s.f_menu_item)


@query
def top_zero_cogs_orders(s: Store) -> DataFrame:
    return reports.top_distinct(margin.zero_cogs_lines(s.f_orders, s.f_order_line, s.f_menu_item), "external_id")


@query
def event_preview(s: Store) -> DataFrame:
    return reports.preview(s.f_event, "event_name", 8)


@query
def orders_in_month(s: Store) -> DataFrame:
    return s.f_orders.filter(F.col("status").isin("delivered", "received") & x.in_previous_month(F.col("placed_at"), AS_OF)).select("order_id", "channel", "status")


# nested source rows


@query
def nested_lines(s: Store) -> DataFrame:
    from ..sources.readers import nest_lines

    nested = nest_lines(s.f_orders.select("order_id"), s.f_order_line.select("order_id", "line_no", "item_id", "qty"), "order_id", "line_no")
    return nested.select("order_id", F.size("lines").cast("long").alias("n_lines"), F.get("lines", F.lit(0))["item_id"].alias("first_item"), F.try_element_at("lines", F.lit(-1))["item_id"].alias("last_item"))


@query
def exploded_lines(s: Store) -> DataFrame:
    from ..sources.readers import explode_lines, nest_lines

    nested = nest_lines(s.f_orders.select("order_id"), s.f_order_line.select("order_id", "line_no", "item_id"), "order_id", "line_no")
    return explode_lines(nested, "order_id").select("order_id", "position", F.col("line.item_id").alias("item_id"))


def _landed(s: Store) -> DataFrame:
    """Orders as their source sends them: one JSON payload each, with its items."""
    cents_of = lambda c: (F.col(c) * 100).cast("long")
    items = s.f_order_line.withColumns({"sku": F.concat(F.lit("part_"), F.col("item_id")), "unit_price_cents": cents_of("unit_price"), "quantity": F.col("qty").cast("int")})
    nested = items.groupBy("order_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "sku", "unit_price_cents", "quantity"))).alias("items"))
    at = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = s.f_orders.join(nested, "order_id")
    body = F.struct(at("placed_at").alias("created_at"), at(F.coalesce("delivered_at", "placed_at")).alias("updated_at"), F.date_add("placed_at", 1).cast("string").alias("delivery_date"), "status", cents_of("gross").alias("subtotal_cents"), cents_of("discounts").alias("discount_cents"), "items")
    return rows.select("external_id", F.to_json(body).alias("payload"))


@query
def landed_orders(s: Store) -> DataFrame:
    orders, _ = payloads.normalize_orders(_landed(s), s.f_menu_item, s.f_recipe, s.f_ingredient)
    money = ("gross", "discounts", "packaging_cost")
    return orders.select("external_id", "status", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("placed_at", "promised_at", "delivered_at")], *[F.col(c).cast("double").alias(c) for c in money])


@query
def landed_order_lines(s: Store) -> DataFrame:
    _, lines = payloads.normalize_orders(_landed(s), s.f_menu_item, s.f_recipe, s.f_ingredient)
    return lines.select("order_id", "line_no", "item_id", *[F.col(c).cast("double").alias(c) for c in ("qty", "unit_price", "unit_cogs_at_time")])


# keyed writes


def _base(s: Store) -> DataFrame:
    return s.orders.filter("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def _incoming(s: Store) -> DataFrame:
    changed = F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus"))
    return s.orders.filter("o_orderkey % 2 = 1 OR o_orderkey % 3 <> 0").select("o_orderkey", (F.col("o_custkey") + 1).alias("o_custkey"), changed.alias("o_orderstatus"), "o_totalprice")


@query
def merge_insert_lines(s: Store) -> DataFrame:
    """Insert-if-absent of lines whose key repeats inside the batch."""
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    lines = s.lineitem.select(*columns, "l_shipdate", "l_extendedprice")
    order = [F.col(c).asc() for c in ("l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")]
    base = merge.latest(lines.filter("l_orderkey % 4 = 0"), ["l_orderkey", "l_linenumber"], order)
    return merge.merge_insert(base, lines, ["l_orderkey", "l_linenumber"], order).select(*columns)


@query
def merge_update_orders(s: Store) -> DataFrame:
    return merge.merge_update(_base(s), _incoming(s), ["o_orderkey"], ["o_orderstatus"], [F.col("o_custkey").asc()])


@query
def merge_newer_events(s: Store) -> DataFrame:
    last = lambda df, order: merge.latest(df, ["user_id"], order)
    rows = s.events.select("user_id", "ts", "event_id", "value")
    base = last(rows.filter("event_id % 2 = 0"), [F.col("ts").desc(), F.col("event_id").desc()])
    inc = last(rows.filter("event_id % 2 = 1 OR event_id % 3 = 0"), [F.col("ts").desc(), F.col("event_id").desc()])
    return merge.merge_newer(base, inc, ["user_id"], "ts", ["ts", "value"], [F.col("event_id").asc()])


@query
def replace_window_ads(s: Store) -> DataFrame:
    rows = s.f_ad_spend.select("day", "platform", "clicks", "impressions")
    inc = rows.filter("day BETWEEN DATE '1996-01-01' AND DATE '1996-02-29' AND clicks % 2 = 0").withColumn("clicks", F.col("clicks") + 1)
    return merge.replace_window(rows, inc, "day", "1996-01-01", "1996-02-29", F.col("platform") == "NO")


@query
def pruned_events(s: Store) -> DataFrame:
    return merge.prune(s.events, "ts", 14, datetime(2024, 1, 31)).select("event_id", "user_id")


@query
def restated_ads(s: Store) -> DataFrame:
    rows = s.f_ad_spend.select("day", "platform", "clicks").withColumn("fetched_at", F.lit("1990-01-01").cast("date"))
    inc = rows.filter("day >= DATE '1998-06-01'").withColumn("clicks", F.col("clicks") * 2).drop("fetched_at")
    return merge.restate_daily(rows, inc, ["day", "platform"], ["clicks"], F.lit("1998-06-15").cast("date"), [F.col("clicks").asc()])


@query
def recipe_versions(s: Store) -> DataFrame:
    changes = s.f_recipe.filter("version = 2 AND item_id % 3 = 0").select("item_id", "ingredient_id", (F.col("qty") + 1).alias("new_qty"))
    out = merge.new_recipe_version(s.f_recipe, changes, AS_OF)
    return out.select("item_id", "ingredient_id", "version", x.as_double(F.col("qty"), 4).alias("qty"), F.col("active_from").cast("date").alias("from_day"), F.col("active_to").cast("date").alias("to_day"))


@query
def price_history(s: Store) -> DataFrame:
    changes = s.f_ingredient.filter("ingredient_id % 4 = 0").select("ingredient_id", (F.col("current_price") * 2).alias("new_price"))
    out = merge.append_price_history(s.f_ingredient, changes, AS_OF)
    return out.select("ingredient_id", F.col("current_price").cast("double").alias("current_price"), F.size("price_history").cast("long").alias("n_history"), F.try_element_at("price_history", F.lit(-1))["price"].cast("double").alias("last_price"))


@query
def erased_customers(s: Store) -> DataFrame:
    keys = s.customer.filter("c_custkey % 10 = 3").select(F.col("c_custkey").alias("customer_id"))
    return merge.erase(keys, "customer_id", {"orders": (s.f_orders.select("order_id", "customer_id"), "customer_id", "set_null")})["orders"]


@query
def placeholder_prices(s: Store) -> DataFrame:
    source = F.when(F.col("ingredient_id") % 3 == 0, "placeholder").otherwise("invoice")
    history = F.array(F.struct(F.lit("placeholder").alias("source")), F.struct(source.alias("source")))
    return reports.placeholder_prices(s.f_ingredient.withColumn("price_history", history))


# joins of lookups


@query
def unknown_items(s: Store) -> DataFrame:
    """What a strict lookup would refuse: items of lines that the even menu lacks."""
    return quality.orphans(s.f_order_line, s.f_menu_item.filter("item_id % 2 = 0"), "item_id").select("item_id").distinct()


@query
def posts_without_snapshot(s: Store) -> DataFrame:
    return quality.orphans(s.f_post.select("post_id", "platform"), s.f_snapshot.filter("post_id % 5 <> 2"), "post_id")


@query
def known_posts_only(s: Store) -> DataFrame:
    rows = s.f_snapshot.select("event_id", (F.col("post_id") * 2).alias("post_id"), "likes")
    return rows.join(s.f_post.select("post_id"), "post_id", "left_semi")


# web


@query
def web_traffic_daily(s: Store) -> DataFrame:
    return web.web_traffic_daily(web.drop_admin(s.f_event))


@query
def web_page_daily(s: Store) -> DataFrame:
    return web.web_page_daily(s.f_event)


@query
def web_acquisition_daily(s: Store) -> DataFrame:
    return web.web_acquisition_daily(s.f_event, SINCE)


@query
def web_event_daily(s: Store) -> DataFrame:
    return web.web_event_daily(s.f_event)


@query
def first_touch(s: Store) -> DataFrame:
    return web.first_touch(s.f_event).select("session", "event_id", "occurred_at", "url")


@query
def page_paths(s: Store) -> DataFrame:
    path = x.path_of(F.col("url"))
    return s.pages.select("page_id", x.locale_of(path).alias("locale"), x.normalize_path(path).alias("path"), x.scrub_url(F.col("url")).alias("scrubbed"), x.query_value(F.col("url"), "utm_source").alias("utm_source"))


@query
def pseudonyms(s: Store) -> DataFrame:
    return s.events.select("event_id", x.pseudonym(F.col("user_id"), SALT).alias("visitor"))


@query
def local_times(s: Store) -> DataFrame:
    """Local days and delivery instants, in summer and winter time."""
    return s.f_orders.select("order_id", x.berlin_day(F.col("placed_at") + F.expr("INTERVAL 22 HOURS 30 MINUTES")).alias("local_day"), x.promised_at(F.col("placed_at").cast("date")).cast("timestamp_ntz").alias("promised"), x.cents(F.when(F.col("order_id") % 5 != 0, F.col("order_id") * 7)).cast("double").alias("discount"))


@query
def post_urls(s: Store) -> DataFrame:
    hosts = F.element_at(F.array(*[F.lit(h) for h in ("www.instagram.com", "m.facebook.com", "youtu.be", "evil.example", "a.threads.net")]), (F.col("page_id") % 5 + 1).cast("int"))
    dressed = F.concat(F.when(F.col("page_id") % 7 == 0, "ftp").otherwise("HTTPS"), F.lit("://"), hosts, F.lit("/p/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, "/?igsh=1").otherwise("#top"))
    return s.pages.select("page_id", x.normalize_post_url(dressed).alias("url"))


@query
def durations(s: Store) -> DataFrame:
    k = F.col("event_id")
    text = F.when(k % 11 == 0, "PT").when(k % 7 == 0, F.concat(F.lit("P1DT"), k % 24, F.lit("H"))).otherwise(F.concat(F.lit("PT"), k % 60, F.lit("M"), k % 61, F.lit("S")))
    return s.events.select("event_id", x.duration_seconds(text).alias("seconds"), x.count_or_null(F.when(k % 3 == 0, F.concat(F.lit("n"), k)).otherwise(k.cast("string"))).alias("n"))


# attribution


def _links(s: Store) -> DataFrame:
    return attribution.links_of_pages(s.pages)


def _variants(s: Store) -> DataFrame:
    return _links(s).select("source", (F.col("link_id") % 10).cast("string").alias("content"), F.col("source").alias("channel"), F.concat(F.lit("camp_"), F.col("link_id") % 7).alias("campaign"), F.concat(F.lit("v_"), F.lpad(F.col("link_id").cast("string"), 8, "0")).alias("variant"))


def _utm_events(s: Store) -> DataFrame:
    rows = attribution.events_with_utm(s.f_event)
    return rows.withColumn("utm_content", F.when(F.col("utm_source").isNotNull(), (F.col("k") % 10).cast("string")))


@query
def resolved_attribution(s: Store) -> DataFrame:
    return attribution.resolve_attribution(_utm_events(s).select("event_id", "utm_source", "utm_content"), _variants(s))


@query
def landed_events(s: Store) -> DataFrame:
    """Behavioural events as their source sends them, with names from a taxonomy and their campaigns."""
    text = lambda c: F.col(c).cast("string")
    rows = _utm_events(s).join(s.events.select("event_id", "event_type", "ts"), "event_id")
    sent = F.map_filter(F.create_map(F.lit("utm_source"), F.col("utm_source"), F.lit("utm_content"), F.col("utm_content"), F.lit("source_order_id"), F.lit("old")), lambda k, v: v.isNotNull())
    raw = rows.select(
        text("event_id").alias("external_id"), F.col("event_type").alias("event_name"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("occurred_at"), F.lit("web").alias("source"), text("visitor").alias("anonymous_id"),
        F.col("session").alias("session_id"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("c"), text("visitor"))).otherwise("").alias("customer_id"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("o"), text("event_id"))).alias("order_id"), sent.alias("properties"),
    )
    got = payloads.normalize_events(raw, s.events.select(F.col("event_type").alias("event_name")).distinct(), _variants(s))
    at = lambda n: F.get_json_object("properties", f"$.{n}")
    return got.select(F.col("external_id").cast("long").alias("event_id"), "event_name", F.col("occurred_at").cast("timestamp_ntz").alias("occurred_at"), "channel", "campaign", "variant", "customer_id", at("source_customer_id").alias("source_customer"), at("source_order_id").alias("source_order"))


@query
def late_attribution(s: Store) -> DataFrame:
    labelled = _utm_events(s).select("event_id", "utm_source", "utm_content", F.when(F.col("event_id") % 2 == 0, "old").alias("channel"), F.lit(None).cast("string").alias("campaign"), F.lit(None).cast("string").alias("variant"))
    return attribution.attribute_late(labelled, _variants(s)).select("event_id", "channel", "campaign", "variant")


def _tracked(s: Store) -> DataFrame:
    content = (F.col("link_id") % 10).cast("string")
    return _links(s).select("link_id", "source", F.concat(F.lit("camp_"), F.col("link_id") % 7).alias("campaign"), content.alias("content"), F.col("link_id").alias("created_at"))


def _seeded_channels(s: Store) -> DataFrame:
    """Two channels of the first source, of which the later one's slug comes first."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(at).cast("long").alias("created_at")) for k, at in (("new-", -1), ("old-", -2))])).alias("x")
    return _links(s).agg(F.min("source").alias("platform")).select("platform", kinds).select(F.concat("x.k", "platform").alias("slug"), F.concat(F.upper("x.k"), F.col("platform")).alias("name"), "platform", "x.created_at")


def _seeded_variants(s: Store) -> DataFrame:
    """One variant that owns a content of the first source."""
    return _links(s).agg(F.min("source").alias("platform")).select(F.lit("taken").alias("slug"), F.lit("kept").alias("campaign"), "platform", F.lit("3").alias("content"))


def _chained(s: Store) -> DataFrame:
    links = _tracked(s)
    return attribution.chained(links, attribution.build_channels(links, _seeded_channels(s)))


@query
def built_channels(s: Store) -> DataFrame:
    return attribution.build_channels(_tracked(s), _seeded_channels(s))


@query
def built_campaigns(s: Store) -> DataFrame:
    return attribution.build_campaigns(_chained(s), s.spark.createDataFrame([], "slug string, name string, started_at long"))


@query
def built_variants(s: Store) -> DataFrame:
    seeded = _seeded_variants(s)
    return attribution.build_variants(attribution.link_clashes(_chained(s), seeded), seeded)


@query
def link_clashes(s: Store) -> DataFrame:
    return attribution.link_clashes(_chained(s), _seeded_variants(s)).select("link_id", "clash", "variant")


@query
def normalized_links(s: Store) -> DataFrame:
    """Events after the whole job over links: those without a label get their link's."""
    posts = s.spark.createDataFrame([], "post_id long, permalink string")
    none = s.spark.createDataFrame([], "slug string, name string, started_at long")
    old = F.when(F.col("event_id") % 2 == 0, "old")
    events = _utm_events(s).select("event_id", "utm_source", "utm_content", old.alias("channel"), F.lit(None).cast("string").alias("campaign"), F.lit(None).cast("string").alias("variant"))
    links = _tracked(s).withColumn("post_url", F.lit(None).cast("string"))
    return attribution.normalize_links(links, posts, _seeded_channels(s), none, _seeded_variants(s), events)["events"].select("event_id", "channel", "campaign", "variant")


@query
def matched_posts(s: Store) -> DataFrame:
    posts = s.f_post.select("post_id", F.concat(F.lit("https://www.instagram.com/p/"), (F.col("post_id") % 50).cast("string"), F.lit("/")).alias("permalink"))
    links = _links(s).select("link_id", F.concat(F.lit("http://instagram.com/p/"), (F.col("link_id") % 60).cast("string"), F.lit("?x=1")).alias("post_url"))
    return attribution.match_posts(links, posts).select("link_id", "post_id")


# posts


@query
def latest_snapshots(s: Store) -> DataFrame:
    return social.latest_snapshot(s.f_snapshot)


@query
def share_extract(s: Store) -> DataFrame:
    return social.share_extract(s.f_post, s.f_snapshot, PLATFORMS)


@query
def engagement_windows(s: Store) -> DataFrame:
    return social.engagement_windows(s.f_post, s.f_snapshot, POSTS_AS_OF)


@query
def engagement_drops(s: Store) -> DataFrame:
    return social.detect_engagement_drop(social.engagement_windows(s.f_post, s.f_snapshot, POSTS_AS_OF)).select("alert_key", "triggered", "severity")


@query
def labelled_posts(s: Store) -> DataFrame:
    return social.label_posts(s.f_post.drop("caption"), s.f_snapshot).select("post_id", "platform", "engagement", "expanding_median", "label")


@query
def class_balance(s: Store) -> DataFrame:
    return social.class_balance(social.label_posts(s.f_post.drop("caption"), s.f_snapshot))


@query
def expanding_folds(s: Store) -> DataFrame:
    return social.expanding_folds(s.f_post.select("post_id", "posted_at")).select("post_id", "fold")


@query
def post_features(s: Store) -> DataFrame:
    return social.build_features(s.f_post).drop("posted_at")


@query
def split_leakage(s: Store) -> DataFrame:
    rows = social.temporal_split(s.f_post, CUTOFF)
    return social.split_leakage(rows.filter("split = 'train'"), rows.filter("split = 'test'"))


@query
def fanout_check(s: Store) -> DataFrame:
    return social.fanout_check(s.f_post, s.f_snapshot, "post_id")


# detectors and audits


@query
def no_orders_alert(s: Store) -> DataFrame:
    hit = alerts.detect_no_orders(s.f_orders, datetime(2002, 1, 1)).withColumn("case_name", F.lit("quiet"))
    return hit.unionByName(alerts.detect_no_orders(s.f_orders, AS_OF).withColumn("case_name", F.lit("busy"))).select("case_name", "alert_key", "triggered", "severity")


@query
def zero_cogs_alert(s: Store) -> DataFrame:
    return alerts.detect_zero_cogs(s.f_orders, s.f_order_line, datetime(1998, 6, 15)).select("alert_key", "triggered", "severity", "detail")


@query
def alert_states(s: Store) -> DataFrame:
    """One step of the alerts' life: open rows of platforms meet today's verdicts."""
    none = F.lit(None).cast("timestamp_ntz")
    verdicts = social.detect_engagement_drop(social.engagement_windows(s.f_post, s.f_snapshot, POSTS_AS_OF))
    odd = F.pmod(F.regexp_extract("alert_key", "([0-9]+)$", 1).cast("int"), F.lit(2)) == 1
    before = verdicts.filter(odd).select("agent", "alert_key", F.lit("warn").alias("severity"), F.lit("before").alias("title"), F.lit("").alias("detail"), F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("detected_at"), none.alias("acknowledged_at"), none.alias("resolved_at"), F.lit(None).cast("string").alias("resolution"))
    out = alerts.upsert_alerts(before, verdicts, POSTS_AS_OF)
    return out.select("alert_key", F.col("detected_at").cast("date").alias("detected"), F.col("resolved_at").cast("date").alias("resolved"), "resolution")


@query
def row_rules(s: Store) -> DataFrame:
    return quality.check_rules(s.f_orders, {"status_known": F.col("status").isin("delivered", "received"), "gross_not_negative": F.col("gross") >= 0, "delivered_has_time": (F.col("status") != "delivered") | F.col("delivered_at").isNotNull(), "delivered_after_placed": F.col("delivered_at") >= F.col("placed_at"), "discount_under_four": F.col("discounts") < 4})


@query
def duplicate_lines(s: Store) -> DataFrame:
    return quality.check_unique(s.lineitem, ["l_orderkey", "l_linenumber"])


@query
def orphan_lines(s: Store) -> DataFrame:
    return quality.orphans(s.f_order_line, s.f_orders.filter("order_id % 3 > 0"), "order_id").select("order_id", "line_no")


@query
def overlapping_windows(s: Store) -> DataFrame:
    stretched = s.f_recipe.withColumn("active_to", F.when((F.col("version") == 1) & (F.col("item_id") % 2 == 0), F.lit(datetime(1999, 1, 1)).cast(s.f_recipe.schema["active_to"].dataType)).otherwise(F.col("active_to")))
    return quality.check_no_overlap(stretched, ["item_id", "ingredient_id"], "active_from", "active_to").select("item_id", "ingredient_id", "version")


@query
def text_leaks(s: Store) -> DataFrame:
    return privacy.leak_report(s.documents, "text")


@query
def admin_dropped(s: Store) -> DataFrame:
    k = F.col("k") % 9
    url = F.when(k == 0, F.concat(F.lit("/admin/"), F.col("k"))).when(k == 1, F.concat(F.lit("/de/admin/"), F.col("k"))).when(k == 2, "/admin?x=1").otherwise(F.col("url"))
    shown = F.when(k == 2, "/shown").when(k == 3, "/admin").when(k == 4, "/administration").otherwise("")
    return web.drop_admin(s.f_event.withColumns({"url": url, "pathname": shown})).select("event_id")


@query
def property_classes(s: Store) -> DataFrame:
    names = F.array(F.lit("$pathname"), F.lit("$geoip_city_name"), F.concat(F.lit("new_"), F.col("event_id") % 3), F.lit("distinct_id"))
    return privacy.classify_keys(s.events.withColumn("properties", F.map_from_arrays(names, F.transform(names, lambda n: F.lit("v")))))


# queues and states of actions and alerts


def _actions(s: Store) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(x) for x in ("proposed", "queued", "approved", "rejected", "expired")]), (F.col("order_id") % 5 + 1).cast("int"))
    return s.f_orders.select(F.col("order_id").alias("action_id"), status.alias("status"), F.col("placed_at").alias("proposed_at"))


def _alerts(s: Store) -> DataFrame:
    grade = F.when(F.col("rating").isNull(), "info").when(F.col("rating") < 3, "critical").otherwise("warn")
    return s.f_review.select(F.col("source").alias("agent"), F.col("rating").cast("string").alias("alert_key"), grade.alias("severity"), F.col("posted_at").alias("detected_at"), F.col("replied_at").alias("resolved_at"), "review_id")


@query
def pending_actions(s: Store) -> DataFrame:
    return reports.pending_actions(_actions(s))


@query
def action_outcomes(s: Store) -> DataFrame:
    return reports.action_outcomes(_actions(s))


@query
def open_alerts(s: Store) -> DataFrame:
    return reports.open_alerts(_alerts(s)).select("review_id", "severity", "detected_at")


@query
def alerts_open_twice(s: Store) -> DataFrame:
    return quality.check_unique(_alerts(s).filter("resolved_at IS NULL"), ["agent", "alert_key"])


# sources in order, and events as they are landed


@query
def source_orders(s: Store) -> DataFrame:
    return readers.read_orders(s.spark, f"{s.folder}/orders.parquet", ["o_orderkey", "o_orderdate", "o_orderstatus"], ["o_orderdate", "o_orderkey"])


@query
def source_events(s: Store) -> DataFrame:
    return readers.read_orders(s.spark, f"{s.folder}/events.parquet", ["event_id", "ts", "event_type"], ["ts", "event_id"])


def _properties(s: Store) -> DataFrame:
    """Events with properties of all classes."""
    text = lambda c: F.col(c).cast("string")
    pairs = {
        "$pathname": x.path_of(F.col("url")), "$current_url": F.concat(F.lit("https://u:p@shop.example"), F.col("url")), "distinct_id": text("visitor"), "$user_id": text("visitor"),
        "title": F.concat(F.lit("[Sale] "), F.repeat(F.col("url"), F.lit(60))), "$geoip_country_code": F.lit("DE"), "$geoip_city_name": F.lit("Bonn"), "$session_entry_fbclid": F.lit("f"),
        "$os": F.lit("linux"), "date": F.lit("2024-01-01"),
    }
    fixed = F.create_map(*[v for k, c in pairs.items() for v in (F.lit(k), c)])
    odd = F.create_map(F.concat(F.lit("new_"), F.col("event_id") % 3), F.lit("v"))
    sent = F.to_json(F.map_concat(fixed, odd))
    nested = F.when(F.col("event_id") % 4 == 0, F.replace(sent, F.lit('"linux"'), F.lit('{"a": [1]}'))).otherwise(sent)
    return s.f_event.select("event_id", "event_name", "visitor", "url", privacy.typed_properties(nested).alias("properties"))


@query
def scrubbed_events(s: Store) -> DataFrame:
    got = privacy.scrub_events(_properties(s), SALT)
    at = lambda n: F.try_element_at("properties", F.lit(n))
    return got.select("event_id", "visitor", F.size("properties").cast("long").alias("n_kept"), at("$current_url").alias("current_url"), at("$user_id").alias("user_hash"), at("title").alias("title"), at("$os").alias("os"))


@query
def unreviewed_properties(s: Store) -> DataFrame:
    return privacy.unreviewed_properties(_properties(s))


@query
def event_leaks(s: Store) -> DataFrame:
    """What the tripwire finds in payloads of which some hold tokens, orders, click ids, keys and customers."""
    k = F.col("event_id")
    planted = F.when(k % 17 == 0, "?token=1").when(k % 13 == 0, "?a=1&order=2").when(k % 11 == 0, "?gclid=3").when(k % 7 == 0, " cus_9").when(k % 5 == 0, " phc_0123456789abcdef0").when(k % 3 == 0, " a.b@c.example").otherwise("?utm_source=x")
    payload = F.to_json(F.create_map(F.lit("uuid"), k.cast("string"), F.lit("$current_url"), F.concat(F.lit("https://shop.example/"), planted)))
    return privacy.leak_report(s.events.select(payload.alias("payload")), "payload")


@query
def event_fields(s: Store) -> DataFrame:
    """Properties whose names begin with a dollar, read from JSON; a missing one is empty."""
    k = F.col("event_id")
    named = F.create_map(F.lit("$pathname"), F.concat(F.lit("/"), F.col("event_type")), F.lit("n"), k.cast("string"))
    more = F.when(k % 2 == 0, F.create_map(F.lit("$session.id"), F.col("user_id").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    raw = s.events.select("event_id", F.to_json(F.map_concat(named, more)).alias("payload"))
    return web.payload_fields(raw, ["$pathname", "$session.id", "$os"]).select("event_id", "pathname", F.col("`session.id`").alias("session_id"), "os")


@query
def threshold_sweep(s: Store) -> DataFrame:
    from ..operators import learning

    return learning.threshold_table(_scores(s))


@query
def score_metrics(s: Store) -> DataFrame:
    from ..operators import learning

    return learning.metrics(_scores(s), 0.49, "platform")


def _scores(s: Store) -> DataFrame:
    p = F.pmod(F.col("doc_id") * 37, F.lit(1009)) / F.lit(1009.0)
    return s.documents.join(s.labels, "doc_id").select(F.col("source").alias("platform"), F.col("quality").alias("label"), p.alias("p"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(f: Callable[[Store], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: f(Store(spark, folder))

    return {name: bind(f) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in oracle.SQL.items()}
