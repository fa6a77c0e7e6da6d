"""Column functions: dates of the business, money, payload fields, URLs, text."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/Berlin"
#: Hosts of posts that may be linked, and prefixes that mean the same site.
POST_HOSTS = ("instagram.com", "facebook.com", "fb.com", "fb.watch", "threads.net", "threads.com", "youtube.com", "youtu.be")
SITE_PREFIX = r"^(www|m|web|mbasic)\."
PLACEHOLDER_DELIVERY_HOUR = 14


def month_bounds(as_of: datetime) -> tuple[Column, Column]:
    """Start and end of the calendar month before ``as_of``; literals, so partitions can be pruned."""
    this = as_of.replace(day=1, hour=0, minute=0, second=0, microsecond=0)
    before = this.replace(year=this.year - 1, month=12) if this.month == 1 else this.replace(month=this.month - 1)
    return F.lit(before).cast("timestamp_ntz"), F.lit(this).cast("timestamp_ntz")


def in_previous_month(ts: Column, as_of: datetime) -> Column:
    start, end = month_bounds(as_of)
    return (ts >= start) & (ts < end)


def since(ts: Column, days: int, as_of: datetime) -> Column:
    return ts >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")


def berlin_day(ts: Column) -> Column:
    """The business day of a UTC instant, summer time included."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), ZONE))


def promised_at(day: Column) -> Column:
    """The instant of the delivery hour, local time, on a day; null stays null."""
    return F.to_utc_timestamp(F.to_timestamp(F.concat(day.cast("string"), F.lit(f" {PLACEHOLDER_DELIVERY_HOUR}:00:00"))), ZONE)


def cents(amount: Column) -> Column:
    """Exact euros; a missing amount is nothing."""
    return (F.coalesce(amount, F.lit(0)).cast("decimal(14,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(12,2)")


def iso_ts(text: Column) -> Column:
    return F.to_timestamp(text)


def locale_of(path: Column) -> Column:
    found = F.regexp_extract(F.coalesce(path, F.lit("")), r"^/([a-z]{2})(/|$)", 1)
    return F.when(found == "", "en").otherwise(found)


def normalize_path(path: Column) -> Column:
    """Without the locale and slashes at the end; nothing left is the front page."""
    rest = F.regexp_replace(F.regexp_replace(F.coalesce(path, F.lit("")), r"^/[a-z]{2}(?=/|$)", ""), r"/+$", "")
    return F.when(rest == "", "/").otherwise(rest)


def path_of(url: Column) -> Column:
    """The path of an absolute or site-relative URL."""
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def query_value(url: Column, name: str) -> Column:
    """A query parameter's value as it stands, null without it."""
    found = F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1)
    return F.when(url.rlike(rf"[?&]{name}="), found)


def normalize_post_url(url: Column) -> Column:
    """http(s) only, lower-case host without one site prefix, known hosts; no query, fragment or slash at the end.

    Null for anything else, and for a site without a path.
    """
    trimmed = F.trim(url)
    scheme = F.lower(F.regexp_extract(trimmed, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(trimmed, r"^[^:]+://(?:[^@/?#]*@)?([^/?#:]+)", 1)), SITE_PREFIX, "")
    path = F.regexp_replace(F.regexp_extract(trimmed, r"^[^:]+://[^/?#]*([^?#]*)", 1), r"/+$", "")
    known = F.lit(False)
    for name in POST_HOSTS:
        known = known | (host == name) | host.endswith("." + name)
    return F.when(scheme.isin("http", "https") & known & (path != ""), F.concat(F.lit("https://"), host, path))


def scrub_url(url: Column) -> Column:
    """Scheme, host without credentials, path and utm_* parameters; a relative URL ends at ? or #."""
    head = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://)", 1)
    authority = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: p.rlike(r"(?i)^utm_(source|medium|campaign|content|term)=")), "&")
    whole = F.concat(head, F.regexp_replace(authority, r"^.*@", ""), path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))
    return F.when(head == "", F.regexp_extract(url, r"^([^?#]*)", 1)).otherwise(whole)


def pseudonym(value: Column, salt: bytes, prefix: str = "ph_") -> Column:
    """Prefix and 32 hex digits of HMAC-SHA256, in SHA-256 steps so that no Python runs."""
    import hashlib

    key = (hashlib.sha256(salt).digest() if len(salt) > 64 else salt).ljust(64, b"\0")
    inner, outer = (bytearray(b ^ pad for b in key) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(F.lit(inner), value.cast("string").cast("binary")), 256))
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(F.lit(outer), first), 256), 1, 32))


def channel_name(source: Column) -> Column:
    return F.initcap(F.translate(source, "_-", "  "))


def duration_seconds(text: Column) -> Column:
    """Seconds of an ISO 8601 duration from days to seconds; null if it is none."""
    pattern = r"^P(?:([0-9]+)D)?(?:T(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+)S)?)?$"
    def part(i: int) -> Column:
        found = F.regexp_extract(text, pattern, i)
        return F.when(found == "", 0).otherwise(found.try_cast("long"))

    total = part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4)
    return F.when(text.rlike(pattern) & text.rlike("[0-9]"), total.cast("long"))


def count_or_null(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("long"))


def hour_bucket(ts: Column) -> Column:
    hour = F.hour(ts)
    return F.when(hour.between(5, 11), "morning").when(hour.between(12, 16), "afternoon").when(hour.between(17, 20), "evening").otherwise("night")


def caption_length(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit("")))


def hashtags(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"#\w+"))


def nullif_zero(x: Column) -> Column:
    return F.when(x != 0, x)


def as_double(x: Column, places: int) -> Column:
    """How results of decimal arithmetic leave: rounded half up, then a double."""
    return F.round(x, places).cast("double")
