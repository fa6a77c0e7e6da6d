"""Privacy: an allowlist for event properties, and a check that fails closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from ..functions.exprs import pseudonym, scrub_url

# The reviewed property names, the ones dropped on purpose, and patterns of the latter.
HASHED = ("distinct_id", "$user_id", "$anon_distinct_id")
KEPT = (
    "$session_id", "$pageview_id", "$current_url", "$pathname", "$host", "$referrer", "$referring_domain", "$search_engine", "$external_click_url", "$event_type", "$is_identified",
    "$cookieless_mode", "title", "navigation_type",
    "$session_entry_url", "$session_entry_host", "$session_entry_pathname", "$session_entry_referrer", "$session_entry_referring_domain", "$session_entry_search_engine",
    "$session_entry_utm_source", "$session_entry_utm_medium", "$session_entry_utm_campaign", "$session_entry_utm_content", "$session_entry_utm_term",
    "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term",
    "$prev_pageview_id", "$prev_pageview_pathname", "$prev_pageview_duration", "$prev_pageview_max_scroll_percentage", "$prev_pageview_max_content_percentage",
    "$prev_pageview_last_scroll_percentage", "$prev_pageview_last_content_percentage", "$prev_pageview_last_content", "$prev_pageview_last_scroll", "$prev_pageview_max_content",
    "$prev_pageview_max_scroll",
    "$web_vitals_FCP_value", "$web_vitals_LCP_value", "$web_vitals_INP_value", "$web_vitals_CLS_value",
    "$browser", "$browser_version", "$browser_language", "$browser_language_prefix", "$os", "$os_version", "$device_type", "$device", "$device_model", "$webview_app",
    "$webview_app_version", "$screen_width", "$screen_height", "$viewport_width", "$viewport_height", "$timezone", "$lib", "$lib_version",
    "$geoip_country_code", "$geoip_country_name", "$geoip_continent_code", "$geoip_continent_name", "$geoip_subdivision_1_code", "$geoip_subdivision_1_name", "$geoip_time_zone",
    "kind", "status", "reason", "date", "fulfillmentType", "itemCount", "totalCents", "feeCents", "distanceKm",
)
DROPPED = (
    "$ip", "$device_id", "$window_id", "$raw_user_agent", "$set", "$set_once", "$el_text", "$elements", "$elements_chain", "token", "$insert_id", "$sent_at", "$time",
    "$timezone_offset", "$config_defaults", "$initialization_time", "$last_posthog_reset", "$recording_status", "$session_recording_start_reason", "$process_person_profile",
    "$had_persisted_distinct_id", "$ce_version", "$sdk_dist_channel", "$web_vitals_allowed_metrics", "$active_feature_flags", "$feature_flag_payloads", "$feature_flag_request_id",
    "$configured_session_timeout_ms", "$snapshot_max_depth_exceeded", "$geoip_latitude", "$geoip_longitude", "$geoip_postal_code", "$geoip_city_name", "$geoip_accuracy_radius",
    "$geoip_subdivision_2_code", "$geoip_subdivision_2_name", "$fbc", "$fbp",
)
DROPPED_PATTERNS = (
    r"^\$sdk_debug_", r"^\$debug_", r"^\$lib_rate_limit", r"^\$web_vitals_\w+_event$", r"^\$\w+_enabled_server_side$", r"^\$\w+_disabled_server_side$",
    r"(?i)(^|[$_])(gclid|gad_source|gclsrc|dclid|gbraid|wbraid|fbclid|msclkid|twclid|li_fat_id|mc_cid|igshid|ttclid|rdt_cid|epik|qclid|sccid|kx|irclid|fbc|fbp)$",
)
URL_NAME = r"(?i)(url|referrer|href)$"
# Lengths that names and values are cut to, and the mark of a reviewed name whose value is no plain one.
NAME_LENGTH, VALUE_LENGTH = 200, 500
NESTED = " (not a plain value)"

#: Kinds of leak in a finished payload, what any of them must contain, and its pattern.
LEAKS = {
    "customer_id": ("_", r"(?i)\bcus?t?_\w"),
    "url_token": ("=", r"(?i)[?&#](token|code|access_token)="),
    "url_order": ("=", r"(?i)[?&]order="),
    "click_id": ("=", r"(?i)[?&](fbclid|gclid|msclkid|ttclid|twclid)="),
    "email": ("@", r"[\w.+-]+@[\w-]+\.[\w.-]+"),
    "analytics_key": ("_", r"\bph[xc]_[A-Za-z0-9]{16,}"),
}


class LeakFound(ValueError):
    """A payload still holds personal data; the message has kinds and counts, never values."""


def typed_properties(payload: Column) -> Column:
    """The properties of a JSON object as a map of variants: text, numbers, objects and lists stay what they are.

    A payload that is no JSON object has none.
    """
    return F.from_json(payload, "map<string,variant>")


def _nested(value: Column) -> Column:
    """Whether a variant is an object or a list; a text that looks like one is not."""
    return F.coalesce(F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)"), F.lit(False))


def _typed(events: DataFrame) -> bool:
    return isinstance(events.schema["properties"].dataType.valueType, VariantType)


def scrub_properties(properties: Column, salt: bytes, typed: bool) -> Column:
    """Reviewed keys of a map: kept, hashed, or scrubbed if named like a URL, and cut to length; a map of strings.

    ``typed``: the values are variants, of which objects and lists are dropped; else they are strings, each
    a plain value. An empty identifier and the copy of the visitor among the properties are dropped too.
    A null map stays null.
    """
    nested = _nested if typed else lambda v: F.lit(False)
    known = lambda k, v: k.isin(*KEPT) & ~nested(v) | k.isin(*HASHED) & (k != "distinct_id") & ~nested(v) & (v.cast("string") != "")
    allowed = F.map_filter(properties, lambda k, v: F.coalesce(known(k, v), F.lit(False)))

    def one(k: Column, v: Column) -> Column:
        v = v.cast("string")
        return F.when(k.isin(*HASHED), pseudonym(v, salt)).otherwise(F.substring(F.when(k.rlike(URL_NAME), scrub_url(v)).otherwise(v), 1, VALUE_LENGTH))

    return F.transform_values(allowed, one)


def scrub_events(events: DataFrame, salt: bytes) -> DataFrame:
    """Events (event_name, visitor, properties) with names cut, visitors hashed and properties scrubbed.

    ``properties``: a map of variants, as ``typed_properties`` gives, or of strings.
    """
    visitor = F.when(F.col("visitor").cast("string") != "", pseudonym(F.col("visitor"), salt))
    return events.withColumns({"event_name": F.substring("event_name", 1, NAME_LENGTH), "visitor": visitor, "properties": scrub_properties(F.col("properties"), salt, _typed(events))})


def classify_keys(events: DataFrame) -> DataFrame:
    """Each property name with its class and count: allowed, dropped, or not yet reviewed.

    An allowed name whose value is an object or a list counts as unreviewed, marked as such.
    """
    allowed = F.col("name").isin(*KEPT, *HASHED)
    # not a plain explode: of that the optimiser makes a filter on the map's size, which parses every payload again
    pairs = events.select(F.explode_outer("properties").alias("name", "value")).filter("name IS NOT NULL")
    nested = _nested(F.col("value")) if _typed(events) else F.lit(False)
    named = F.when(allowed & (F.col("name") != "distinct_id") & nested, F.concat("name", F.lit(NESTED))).otherwise(F.col("name"))
    keys = pairs.select(named.alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    dropped = F.col("name").isin(*DROPPED)
    for pattern in DROPPED_PATTERNS:
        dropped = dropped | F.col("name").rlike(pattern)
    return keys.select("name", F.when(allowed, "allowed").when(dropped, "dropped").otherwise("unreviewed").alias("kind"), "n")


def unreviewed_properties(events: DataFrame) -> DataFrame:
    return classify_keys(events).filter(F.col("kind") == "unreviewed").select("name", "n").orderBy(F.desc("n"), "name")


def leak_report(df: DataFrame, column: str) -> DataFrame:
    """Rows by kind of leak, in one pass over the column; a plain search spares most rows the pattern."""
    text = F.col(column)
    counted = df.agg(*[F.count(F.when(text.contains(sign) & text.rlike(p), 1)).alias(k) for k, (sign, p) in LEAKS.items()])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in LEAKS])))


def assert_clean(df: DataFrame, column: str) -> DataFrame:
    """``df`` itself if no row leaks; raises before anything is written."""
    found = {r["kind"]: r["n"] for r in leak_report(df, column).filter("n > 0").collect()}
    if found:
        raise LeakFound(f"payloads leak: {found}")
    return df
