"""Links, channels and campaigns: building them, and labelling events by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import channel_name, normalize_post_url, query_value
from .merge import latest

#: The kind of a channel by the medium of the link that makes it.
KIND_OF_MEDIUM = {"organic_social": "organic_social", "story": "organic_social", "bio": "organic_social", "creator": "organic_social", "community": "organic_social", "message": "owned", "email": "owned", "print": "offline"}


def events_with_utm(events: DataFrame) -> DataFrame:
    url = F.col("url")
    return events.withColumns({"utm_source": query_value(url, "utm_source"), "utm_content": query_value(url, "utm_content")})


def links_of_pages(pages: DataFrame) -> DataFrame:
    """Tracked links: pages whose URL names a source. The content is the page."""
    source = query_value(F.col("url"), "utm_source")
    return pages.select(F.col("page_id").alias("link_id"), source.alias("source"), F.col("page_id").cast("string").alias("content"), "url").filter(F.col("source").isNotNull())


def build_channels(links: DataFrame, channels: DataFrame) -> DataFrame:
    """Channels (slug, name, platform, created_at, and kind if given) with one for each platform that has none.

    A new channel has its platform as slug, its title as name, the time of its first link, and the kind
    that this link's medium stands for. A slug that another platform's channel has already is an error, which
    names it: without a channel the platform's links would be lost.
    """
    first = links.groupBy(F.col("source").alias("platform")).agg(F.min_by(F.struct("created_at", *(["medium"] if "medium" in links.columns else [])), F.struct("created_at", "link_id")).alias("first"))
    missing = first.join(channels.select("platform"), "platform", "left_anti")
    taken = channels.select(F.col("slug").alias("platform"), F.lit(True).alias("_taken")).distinct()
    refused = F.raise_error(F.concat(F.lit("the channel slug "), F.col("platform"), F.lit(" belongs to another platform"))).cast("string")
    missing = missing.join(taken, "platform", "left").withColumn("slug", F.when(F.col("_taken"), refused).otherwise(F.col("platform")))
    made = {"name": channel_name(F.col("slug")), "created_at": F.col("first.created_at")}
    if "kind" in channels.columns:
        made["kind"] = F.try_element_at(F.create_map(*[F.lit(x) for pair in KIND_OF_MEDIUM.items() for x in pair]), F.col("first.medium"))
    return channels.unionByName(missing.withColumns(made).select(*channels.columns))


def platform_channel(channels: DataFrame) -> DataFrame:
    """The channel that stands for each platform: the earliest, then the least slug."""
    return latest(channels, ["platform"], [F.col("created_at").asc(), F.col("slug").asc()])


def chained(links: DataFrame, channels: DataFrame) -> DataFrame:
    """Links (link_id, source, campaign, content, ...) with channel, channel_name, campaign_slug and variant, each slug from the one before."""
    one = platform_channel(channels).select(F.col("platform").alias("source"), F.col("slug").alias("channel"), F.col("name").alias("channel_name"))
    slug = F.concat_ws("-", "channel", "campaign")
    return links.join(one, "source").withColumns({"campaign_slug": slug, "variant": F.concat_ws("-", slug, "content")})


def build_campaigns(links: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Campaigns (slug, name, started_at) with one for each slug of ``chained`` links that has none, dated by its first link."""
    dated = links.groupBy(F.col("campaign_slug").alias("slug")).agg(F.first(F.concat_ws(" - ", "channel_name", "campaign")).alias("name"), F.min("created_at").alias("started_at"))
    return campaigns.unionByName(dated.join(campaigns.select("slug"), "slug", "left_anti").select(*campaigns.columns))


def link_clashes(links: DataFrame, variants: DataFrame) -> DataFrame:
    """``chained`` links with ``clash``, and without a variant where another one owns their platform and content.

    ``variants``: slug, platform, content. Those that exist own their content; of new ones the first
    link's does.
    """
    old = variants.groupBy(F.col("platform").alias("source"), "content").agg(F.min("slug").alias("_low"), F.max("slug").alias("_high"))
    first = links.groupBy("source", "content").agg(F.min_by("variant", F.struct("created_at", "link_id")).alias("_first"))
    owned = first.join(old, ["source", "content"], "left").select("source", "content", F.coalesce("_low", "_first").alias("_low"), F.coalesce("_high", "_first").alias("_high"))
    clash = (F.col("_low") != F.col("variant")) | (F.col("_high") != F.col("variant"))
    return links.join(owned, ["source", "content"]).withColumn("clash", clash).withColumn("variant", F.when(~F.col("clash"), F.col("variant"))).drop("_low", "_high")


def build_variants(settled: DataFrame, variants: DataFrame) -> DataFrame:
    """Variants (slug, campaign, platform, content) with one for each slug of links without a clash that has none."""
    made = settled.filter(~F.col("clash")).groupBy(F.col("variant").alias("slug")).agg(F.first("campaign_slug").alias("campaign"), F.first("source").alias("platform"), F.first("content").alias("content"))
    return variants.unionByName(made.join(variants.select("slug"), "slug", "left_anti").select(*variants.columns))


def resolve_attribution(events: DataFrame, variants: DataFrame) -> DataFrame:
    """Events with channel, campaign and variant by (utm_source, utm_content); nulls where none fits.

    ``variants``: source, content, channel, campaign, variant. Of several, the least variant counts.
    """
    one = latest(variants, ["source", "content"], [F.col("variant").asc()])
    one = one.select(F.col("source").alias("_source"), F.col("content").alias("_content"), "channel", "campaign", "variant")
    blank = (F.coalesce("utm_source", F.lit("")) == "") | (F.coalesce("utm_content", F.lit("")) == "")
    keyed = events.withColumns({"_source": F.when(~blank, F.col("utm_source")), "_content": F.when(~blank, F.col("utm_content"))})
    return keyed.join(one, ["_source", "_content"], "left").drop("_source", "_content")


def attribute_late(events: DataFrame, variants: DataFrame) -> DataFrame:
    """Fill channel, campaign and variant of events that have none of them; labelled events stay."""
    one = latest(variants, ["source", "content"], [F.col("variant").asc()])
    e, v = events.alias("e"), one.alias("v")
    on = (F.col("e.utm_source") == F.col("v.source")) & (F.col("e.utm_content") == F.col("v.content"))
    empty = F.col("e.channel").isNull() & F.col("e.campaign").isNull() & F.col("e.variant").isNull()
    labels = ("channel", "campaign", "variant")
    return e.join(v, on, "left").select(*[F.when(empty, F.col(f"v.{c}")).otherwise(F.col(f"e.{c}")).alias(c) if c in labels else F.col(f"e.{c}") for c in events.columns])


def match_posts(links: DataFrame, posts: DataFrame) -> DataFrame:
    """Links with the post that their URL names, dress removed; the last post of an address wins, none is null."""
    by = posts.withColumn("_url", normalize_post_url(F.col("permalink"))).filter("_url IS NOT NULL")
    by = by.groupBy("_url").agg(F.max("post_id").alias("post_id"))
    return links.withColumn("_url", normalize_post_url(F.col("post_url"))).join(by, "_url", "left").drop("_url")


def shared_contents(links: DataFrame) -> DataFrame:
    """Contents that several links of a source use, with how many."""
    n = F.count("*").over(Window.partitionBy("source", "content"))
    return links.withColumn("n", n).filter("n > 1").select("source", "content", "link_id", "n")


def normalize_links(links: DataFrame, posts: DataFrame, channels: DataFrame, campaigns: DataFrame, variants: DataFrame, events: DataFrame | None = None) -> dict[str, DataFrame]:
    """The dimension tables after ``links`` (link_id, source, content, campaign, created_at, post_url), and the links.

    A platform's earliest channel is used again, a missing one made; campaigns and variants follow by
    their slugs, a variant for each link whose content no other variant of the platform owns; each
    link gets its post where its address names one. Given ``events`` (utm_source, utm_content,
    channel, campaign, variant), those without any label get that of the links' variants. A second
    run with the same links changes nothing.
    """
    grown = build_channels(links, channels)
    keyed = chained(links, grown)
    settled = link_clashes(keyed, variants)
    out = {"channels": grown, "campaigns": build_campaigns(keyed, campaigns), "variants": build_variants(settled, variants), "links": match_posts(settled, posts)}
    if events is not None:
        own = settled.filter(F.col("variant").isNotNull()).select("source", "content", "channel", F.col("campaign_slug").alias("campaign"), "variant").distinct()
        out["events"] = attribute_late(events, own)
    return out
