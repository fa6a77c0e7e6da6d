"""SQL for the other engine, one statement for each query of the catalogue that SQL can express."""

from __future__ import annotations

_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY captured_at DESC, event_id DESC) AS rk FROM f_snapshot) WHERE rk = 1"
_DAY = "CAST((occurred_at AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin' AS DATE)"
_PATH = r"regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)', 1)"
_LOCALE = f"CASE WHEN regexp_extract({_PATH}, '^/([a-z]{{2}})(/|$)', 1) = '' THEN 'en' ELSE regexp_extract({_PATH}, '^/([a-z]{{2}})(/|$)', 1) END"
_REST = f"regexp_replace(regexp_replace({_PATH}, '^/[a-z]{{2}}(/|$)', '/'), '/+$', '')"
_NORM = f"CASE WHEN {_REST} = '' THEN '/' ELSE {_REST} END"
_UTM = lambda n: f"CASE WHEN regexp_matches(url, '[?&]{n}=') THEN regexp_extract(url, '[?&]{n}=([^&#]*)', 1) END"
_WINDOWS = f"""
  SELECT p.platform, CASE WHEN p.posted_at >= TIMESTAMP '2024-01-16 12:00:00' THEN 'recent' ELSE 'prior' END AS bucket,
    count(*) AS post_count, round(avg(coalesce(s.likes, 0) + coalesce(s.comments, 0) + coalesce(s.shares, 0)), 6) AS avg_engagement
  FROM f_post p JOIN ({_LATEST}) s ON s.post_id = p.post_id WHERE p.posted_at >= TIMESTAMP '2024-01-02 12:00:00' GROUP BY ALL"""
_VERDICTS = f"""
  SELECT 'social_engagement_drop_' || platform AS alert_key, platform,
    coalesce(rn >= 3 AND pn >= 3 AND (pa - ra) / nullif(pa, 0) >= 0.3, false) AS triggered
  FROM (SELECT platform, max(post_count) FILTER (bucket = 'recent') AS rn, max(post_count) FILTER (bucket = 'prior') AS pn,
    max(avg_engagement) FILTER (bucket = 'recent') AS ra, max(avg_engagement) FILTER (bucket = 'prior') AS pa FROM ({_WINDOWS}) GROUP BY platform)"""
_LABELLED = f"""
  SELECT post_id, platform, engagement, expanding_median, CASE WHEN engagement > expanding_median THEN 1 ELSE 0 END AS label FROM (
    SELECT p.post_id, p.platform, e.engagement, quantile_cont(e.engagement, 0.5) OVER (PARTITION BY p.platform ORDER BY p.posted_at, p.post_id ROWS UNBOUNDED PRECEDING) AS expanding_median
    FROM f_post p JOIN (SELECT post_id, coalesce(likes, 0) + coalesce(comments, 0) + coalesce(shares, 0) AS engagement FROM ({_LATEST})) e ON e.post_id = p.post_id)"""
_LINKS = f"SELECT page_id AS link_id, {_UTM('utm_source')} AS source, url FROM pages WHERE regexp_matches(url, '[?&]utm_source=')"
_VARIANTS = f"""
  SELECT source, content, source AS channel, campaign, variant FROM (
    SELECT source, CAST(link_id % 10 AS VARCHAR) AS content, 'camp_' || CAST(link_id % 7 AS VARCHAR) AS campaign, 'v_' || lpad(CAST(link_id AS VARCHAR), 8, '0') AS variant,
      row_number() OVER (PARTITION BY source, link_id % 10 ORDER BY link_id) AS rk FROM ({_LINKS})) WHERE rk = 1"""
_UTM_EVENTS = f"SELECT event_id, utm_source, CASE WHEN utm_source IS NOT NULL THEN CAST(k % 10 AS VARCHAR) END AS utm_content FROM (SELECT event_id, k, {_UTM('utm_source')} AS utm_source FROM f_event)"
_SCORES = "SELECT d.source AS platform, l.quality AS label, ((d.doc_id * 37) % 1009) / 1009.0 AS p FROM documents d JOIN labels l ON l.doc_id = d.doc_id"
# The kinds of leak and their patterns.
_LEAK = {
    "customer_id": r"(?i)\bcus?t?_\w",
    "url_token": r"(?i)[?&#](token|code|access_token)=",
    "url_order": r"(?i)[?&]order=",
    "click_id": r"(?i)[?&](fbclid|gclid|msclkid|ttclid|twclid)=",
    "email": r"[\w.+-]+@[\w-]+\.[\w.-]+",
    "analytics_key": r"\bph[xc]_[A-Za-z0-9]{16,}",
}
_TRACKED = f"SELECT link_id, source, 'camp_' || CAST(link_id % 7 AS VARCHAR) AS campaign, CAST(link_id % 10 AS VARCHAR) AS content FROM ({_LINKS})"
_SEEDED = f"SELECT k || source AS slug, upper(k) || source AS name, source AS platform, made AS created_at FROM (SELECT min(source) AS source FROM ({_LINKS})) CROSS JOIN (VALUES ('new-', CAST(-1 AS BIGINT)), ('old-', CAST(-2 AS BIGINT))) t(k, made)"
_TITLE = "array_to_string(list_transform(string_split(translate(source, '_-', '  '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
_CHANNELS = f"{_SEEDED} UNION ALL SELECT source, {_TITLE}, source, min(link_id) FROM ({_TRACKED}) WHERE source <> (SELECT min(source) FROM ({_LINKS})) GROUP BY source"
_CHAINED = f"""
  SELECT l.*, c.slug AS channel, c.slug || '-' || campaign AS campaign_slug, c.name || ' - ' || campaign AS campaign_name, c.slug || '-' || campaign || '-' || content AS variant
  FROM ({_TRACKED}) l JOIN (SELECT platform, arg_min(slug, created_at) AS slug, arg_min(name, created_at) AS name FROM ({_CHANNELS}) GROUP BY platform) c ON c.platform = l.source"""
_OWNED = f"""
  SELECT k.*, CASE WHEN k.source = (SELECT min(source) FROM ({_LINKS})) AND k.content = '3' THEN 'taken' ELSE f.variant END AS owner
  FROM ({_CHAINED}) k JOIN (SELECT source, content, arg_min(variant, link_id) AS variant FROM ({_CHAINED}) GROUP BY ALL) f ON f.source = k.source AND f.content = k.content"""
_COUNTED = ("orders", "lineitem", "part", "supplier", "events", "pages", "documents")

_KEY = b"a salt of the tests".ljust(64, b"\0")
_INNER, _OUTER = (bytes(b ^ pad for b in _KEY).hex() for pad in (0x36, 0x5C))
_HASHED = f"'ph_' || substr(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(CAST(visitor AS VARCHAR))))), 1, 32)"
_PLANTED = """
  SELECT '{"uuid":"' || CAST(event_id AS VARCHAR) || '","$current_url":"https://shop.example/' || CASE WHEN event_id % 17 = 0 THEN '?token=1' WHEN event_id % 13 = 0 THEN '?a=1&order=2'
    WHEN event_id % 11 = 0 THEN '?gclid=3' WHEN event_id % 7 = 0 THEN ' cus_9' WHEN event_id % 5 = 0 THEN ' phc_0123456789abcdef0' WHEN event_id % 3 = 0 THEN ' a.b@c.example' ELSE '?utm_source=x' END || '"}' AS payload FROM events"""

SQL = {
    "pseudonyms": f"SELECT event_id, 'ph_' || substr(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(CAST(user_id AS VARCHAR))))), 1, 32) AS visitor FROM events",
    "true_margin": """
WITH cost AS (SELECT order_id, sum(qty * unit_cogs_at_time) AS cogs FROM f_order_line GROUP BY order_id),
rows AS (
  SELECT o.*, c.cogs, o.channel_fee + o.packaging_cost + o.delivery_cost AS direct, o.gross - o.discounts - o.channel_fee - o.packaging_cost - o.delivery_cost - c.cogs AS margin
  FROM f_orders o JOIN cost c ON c.order_id = o.order_id
  WHERE o.status = 'delivered' AND o.placed_at >= TIMESTAMP '1998-05-01 00:00:00' AND o.placed_at < TIMESTAMP '1998-06-01 00:00:00')
SELECT channel, count(*) AS orders, CAST(round(sum(gross), 2) AS DOUBLE) AS gross, CAST(round(sum(discounts), 2) AS DOUBLE) AS discounts,
  CAST(round(sum(direct), 2) AS DOUBLE) AS direct_costs, CAST(round(sum(cogs), 2) AS DOUBLE) AS cogs, CAST(round(sum(margin), 2) AS DOUBLE) AS true_margin,
  CAST(round(100 * sum(margin) / nullif(sum(gross - discounts), 0), 1) AS DOUBLE) AS true_margin_pct,
  count(*) FILTER (net_margin IS NULL) AS uncached, CAST(round(coalesce(sum(net_margin - margin), 0), 2) AS DOUBLE) AS cached_margin_drift
FROM rows GROUP BY channel""",
    "order_cogs": "SELECT order_id, CAST(round(sum(qty * unit_cogs_at_time), 4) AS DOUBLE) AS cogs FROM f_order_line GROUP BY order_id",
    "unit_cogs_at": """
SELECT l.order_id, l.line_no, CAST(round(coalesce(sum(r.qty / r.yield_factor * i.current_price), 0), 4) AS DOUBLE) AS unit_cogs
FROM f_order_line l JOIN f_orders o ON o.order_id = l.order_id
LEFT JOIN f_recipe r ON r.item_id = l.item_id AND o.placed_at >= r.active_from AND (r.active_to IS NULL OR o.placed_at < r.active_to)
LEFT JOIN f_ingredient i ON i.ingredient_id = r.ingredient_id GROUP BY l.order_id, l.line_no""",
    "dish_margin": """
WITH c AS (
  SELECT m.slug, m.current_price, sum(r.qty / r.yield_factor * i.current_price) AS cost FROM f_recipe r
  JOIN f_menu_item m ON m.item_id = r.item_id JOIN f_ingredient i ON i.ingredient_id = r.ingredient_id WHERE r.active_to IS NULL GROUP BY ALL)
SELECT slug, CAST(current_price AS DOUBLE) AS current_price, CAST(round(cost, 4) AS DOUBLE) AS cogs, CAST(round(current_price - cost, 2) AS DOUBLE) AS gross_margin_eur,
  CAST(round(100 * (current_price - cost) / nullif(current_price, 0), 1) AS DOUBLE) AS gross_margin_pct FROM c""",
    "recipe_breakdown": """
SELECT m.slug AS dish, i.slug AS ingredient, CAST(r.qty AS DOUBLE) AS qty, CAST(r.yield_factor AS DOUBLE) AS yield_factor,
  CAST(round(r.qty / r.yield_factor, 4) AS DOUBLE) AS gross_qty_to_purchase, CAST(round(r.qty / r.yield_factor * i.current_price, 4) AS DOUBLE) AS line_cost_eur
FROM f_recipe r JOIN f_menu_item m ON m.item_id = r.item_id JOIN f_ingredient i ON i.ingredient_id = r.ingredient_id WHERE r.active_to IS NULL AND m.slug = 'part_7'""",
    "zero_cogs_lines": """
SELECT o.channel, o.external_id, l.line_no, m.name_en FROM f_order_line l JOIN f_orders o ON o.order_id = l.order_id JOIN f_menu_item m ON m.item_id = l.item_id
WHERE o.status = 'delivered' AND l.unit_cogs_at_time = 0""",
    "zero_cogs_count": "SELECT count(*) AS zero_cogs_lines FROM f_order_line l JOIN f_orders o ON o.order_id = l.order_id WHERE o.status = 'delivered' AND l.unit_cogs_at_time = 0",
    "ad_efficiency": """
SELECT platform, CAST(round(sum(spend), 2) AS DOUBLE) AS spend, CAST(sum(attributed_orders) AS BIGINT) AS attributed_orders,
  CAST(round(sum(spend) / nullif(sum(attributed_orders), 0), 2) AS DOUBLE) AS cac_eur
FROM f_ad_spend WHERE day >= DATE '1998-05-01' AND day < DATE '1998-06-01' GROUP BY platform""",
    "recent_orders": """
SELECT o.channel, o.external_id, o.placed_at, o.status, CAST(o.gross AS DOUBLE) AS gross, m.name_en, l.line_no, CAST(l.qty AS DOUBLE) AS qty, CAST(l.unit_price AS DOUBLE) AS unit_price
FROM f_orders o JOIN f_order_line l ON l.order_id = o.order_id JOIN f_menu_item m ON m.item_id = l.item_id ORDER BY o.placed_at DESC, o.order_id, l.line_no LIMIT 50""",
    "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in _COUNTED),
    "repeat_customers": "SELECT count(*) FILTER (n = 1) AS one_time, count(*) FILTER (n > 1) AS repeat_customers FROM (SELECT customer_id, count(*) AS n FROM f_orders WHERE customer_id IS NOT NULL GROUP BY 1)",
    "review_queue": "SELECT review_id, source, rating, text, posted_at FROM f_review WHERE replied_at IS NULL AND rating < 4",
    "ingredient_suppliers": "SELECT i.slug, n.n_name AS supplier FROM f_ingredient i LEFT JOIN nation n ON n.n_nationkey = i.supplier_id",
    "supplier_ranking": "SELECT lower(s_name) AS slug, CASE WHEN s_suppkey % 5 <> 0 THEN round(s_acctbal, 2) END AS reliability_score FROM supplier",
    "menu_by_price": "SELECT slug, category, CAST(current_price AS DOUBLE) AS current_price FROM f_menu_item",
    "top_zero_cogs_orders": """
SELECT DISTINCT o.external_id FROM f_order_line l JOIN f_orders o ON o.order_id = l.order_id JOIN f_menu_item m ON m.item_id = l.item_id
WHERE o.status = 'delivered' AND l.unit_cogs_at_time = 0 ORDER BY 1 LIMIT 20""",
    "event_preview": "SELECT event_name, count(*) AS n FROM f_event GROUP BY 1 ORDER BY n DESC, event_name LIMIT 8",
    "orders_in_month": "SELECT order_id, channel, status FROM f_orders WHERE status IN ('delivered', 'received') AND placed_at >= TIMESTAMP '1998-05-01 00:00:00' AND placed_at < TIMESTAMP '1998-06-01 00:00:00'",
    "nested_lines": """
SELECT o.order_id, count(l.line_no) AS n_lines, arg_min(l.item_id, l.line_no) AS first_item, arg_max(l.item_id, l.line_no) AS last_item
FROM f_orders o LEFT JOIN f_order_line l ON l.order_id = o.order_id GROUP BY o.order_id""",
    "exploded_lines": """
SELECT l.order_id, CAST(row_number() OVER (PARTITION BY l.order_id ORDER BY l.line_no) AS INTEGER) AS position, l.item_id
FROM f_order_line l SEMI JOIN f_orders o ON o.order_id = l.order_id""",
    "landed_orders": """
SELECT o.external_id, o.status, o.placed_at, ((CAST(o.placed_at AS DATE) + INTERVAL '1' DAY + INTERVAL '14' HOUR) AT TIME ZONE 'Europe/Berlin') AT TIME ZONE 'UTC' AS promised_at,
  o.delivered_at, CAST(o.gross AS DOUBLE) AS gross, CAST(o.discounts AS DOUBLE) AS discounts, CAST(0.5 AS DOUBLE) AS packaging_cost
FROM f_orders o SEMI JOIN f_order_line l ON l.order_id = o.order_id""",
    "landed_order_lines": """
WITH n AS (SELECT *, CAST(row_number() OVER (PARTITION BY order_id ORDER BY line_no) AS INTEGER) AS place FROM f_order_line)
SELECT o.external_id AS order_id, n.place AS line_no, n.item_id, CAST(n.qty AS DOUBLE) AS qty, CAST(n.unit_price AS DOUBLE) AS unit_price,
  CAST(round(coalesce(sum(r.qty / r.yield_factor * i.current_price), 0), 4) AS DOUBLE) AS unit_cogs_at_time
FROM n JOIN f_orders o ON o.order_id = n.order_id
LEFT JOIN f_recipe r ON r.item_id = n.item_id AND o.placed_at >= r.active_from AND (r.active_to IS NULL OR o.placed_at < r.active_to)
LEFT JOIN f_ingredient i ON i.ingredient_id = r.ingredient_id GROUP BY ALL""",
    "merge_insert_lines": """
WITH r AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS rk FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM r WHERE rk = 1""",
    "merge_update_orders": """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE o_custkey + 1 END AS o_custkey,
  CASE WHEN (o_orderkey % 2 = 1 OR o_orderkey % 3 <> 0) AND o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders""",
    "merge_newer_events": """
WITH b AS (SELECT * FROM (SELECT user_id, ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events WHERE event_id % 2 = 0) WHERE rk = 1),
i AS (SELECT * FROM (SELECT user_id, ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events WHERE event_id % 2 = 1 OR event_id % 3 = 0) WHERE rk = 1)
SELECT coalesce(b.user_id, i.user_id) AS user_id, CASE WHEN b.user_id IS NULL OR b.ts <= i.ts THEN i.ts ELSE b.ts END AS ts,
  CASE WHEN b.user_id IS NULL THEN i.event_id ELSE b.event_id END AS event_id, CASE WHEN b.user_id IS NULL OR b.ts <= i.ts THEN i.value ELSE b.value END AS value
FROM b FULL JOIN i ON b.user_id = i.user_id""",
    "replace_window_ads": """
SELECT day, platform, CAST(clicks AS BIGINT) AS clicks, CAST(impressions AS BIGINT) AS impressions FROM f_ad_spend
WHERE NOT (day BETWEEN DATE '1996-01-01' AND DATE '1996-02-29' AND platform = 'NO')
UNION ALL SELECT day, platform, CAST(clicks + 1 AS BIGINT), CAST(impressions AS BIGINT) FROM f_ad_spend WHERE day BETWEEN DATE '1996-01-01' AND DATE '1996-02-29' AND clicks % 2 = 0""",
    "pruned_events": "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-17 00:00:00'",
    "restated_ads": """
SELECT day, platform, CAST(CASE WHEN day >= DATE '1998-06-01' THEN clicks * 2 ELSE clicks END AS BIGINT) AS clicks,
  CASE WHEN day >= DATE '1998-06-01' THEN DATE '1998-06-15' ELSE DATE '1990-01-01' END AS fetched_at FROM f_ad_spend""",
    "recipe_versions": """
SELECT item_id, ingredient_id, version, CAST(qty AS DOUBLE) AS qty, CAST(active_from AS DATE) AS from_day,
  CASE WHEN version = 2 AND item_id % 3 = 0 THEN DATE '1998-06-15' ELSE CAST(active_to AS DATE) END AS to_day FROM f_recipe
UNION ALL SELECT item_id, ingredient_id, 3, CAST(qty + 1 AS DOUBLE), DATE '1998-06-15', NULL FROM f_recipe WHERE version = 2 AND item_id % 3 = 0""",
    "price_history": """
SELECT ingredient_id, CAST(current_price * CASE WHEN ingredient_id % 4 = 0 THEN 2 ELSE 1 END AS DOUBLE) AS current_price,
  CAST(CASE WHEN ingredient_id % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_history, CASE WHEN ingredient_id % 4 = 0 THEN CAST(current_price AS DOUBLE) END AS last_price FROM f_ingredient""",
    "erased_customers": "SELECT order_id, CASE WHEN customer_id % 10 = 3 AND customer_id IN (SELECT c_custkey FROM customer) THEN NULL ELSE customer_id END AS customer_id FROM f_orders",
    "placeholder_prices": "SELECT ingredient_id, slug FROM f_ingredient WHERE ingredient_id % 3 = 0",
    "unknown_items": "SELECT DISTINCT item_id FROM f_order_line WHERE item_id NOT IN (SELECT item_id FROM f_menu_item WHERE item_id % 2 = 0)",
    "posts_without_snapshot": "SELECT post_id, platform FROM f_post WHERE post_id NOT IN (SELECT post_id FROM f_snapshot WHERE post_id % 5 <> 2)",
    "known_posts_only": "SELECT event_id, post_id * 2 AS post_id, likes FROM f_snapshot WHERE post_id * 2 IN (SELECT post_id FROM f_post)",
    "web_traffic_daily": f"SELECT {_DAY} AS day, {_LOCALE} AS locale, count(*) AS pageviews, count(DISTINCT session) AS sessions, count(DISTINCT visitor) AS visitors FROM f_event WHERE event_name = '$pageview' AND NOT regexp_matches({_PATH}, '^/admin(/|$)') GROUP BY ALL",
    "web_page_daily": f"SELECT {_DAY} AS day, {_LOCALE} AS locale, {_NORM} AS path, count(*) AS pageviews, count(DISTINCT session) AS sessions, count(DISTINCT visitor) AS visitors FROM f_event WHERE event_name = '$pageview' GROUP BY ALL",
    "web_event_daily": f"SELECT {_DAY} AS day, event_name, count(*) AS events, count(DISTINCT session) AS sessions, count(DISTINCT visitor) AS visitors FROM f_event WHERE event_name NOT LIKE '$%' GROUP BY ALL",
    "web_acquisition_daily": f"""
WITH f AS (
  SELECT {_DAY} AS day, url, row_number() OVER (PARTITION BY session ORDER BY occurred_at, event_id) AS rk FROM f_event
  WHERE event_name = '$pageview' AND session IS NOT NULL AND {_DAY} >= DATE '2024-01-07')
SELECT day, coalesce({_UTM('utm_source')}, '') AS utm_source, coalesce({_UTM('utm_medium')}, '') AS utm_medium, coalesce({_UTM('utm_campaign')}, '') AS utm_campaign,
  coalesce({_UTM('utm_content')}, '') AS utm_content, count(*) AS sessions FROM f WHERE rk = 1 AND day >= DATE '2024-01-08' GROUP BY ALL""",
    "first_touch": "SELECT session, event_id, occurred_at, url FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY occurred_at, event_id) AS rk FROM f_event WHERE event_name = '$pageview' AND session IS NOT NULL) WHERE rk = 1",
    "page_paths": rf"""
WITH q AS (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '^utm_[a-z]+=')) AS kept FROM pages)
SELECT page_id, {_LOCALE} AS locale, {_NORM} AS path,
  CASE WHEN NOT regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN regexp_extract(url, '^([^?#]*)', 1)
    ELSE regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://)', 1) || regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), '^.*@', '')
      || regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS scrubbed,
  {_UTM('utm_source')} AS utm_source FROM q""",
    "local_times": """
SELECT order_id, CAST(((placed_at + INTERVAL '22' HOUR + INTERVAL '30' MINUTE) AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin' AS DATE) AS local_day,
  ((CAST(placed_at AS DATE) + INTERVAL '14' HOUR) AT TIME ZONE 'Europe/Berlin') AT TIME ZONE 'UTC' AS promised,
  CAST(CASE WHEN order_id % 5 <> 0 THEN order_id * 7 ELSE 0 END / 100.0 AS DOUBLE) AS discount FROM f_orders""",
    "post_urls": """
SELECT page_id, CASE WHEN page_id % 7 <> 0 AND page_id % 5 <> 3 THEN 'https://' || (['instagram.com', 'facebook.com', 'youtu.be', '', 'a.threads.net'])[CAST(page_id % 5 + 1 AS INTEGER)] || '/p/' || CAST(page_id AS VARCHAR) END AS url FROM pages""",
    "durations": """
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 86400 + (event_id % 24) * 3600 ELSE (event_id % 60) * 60 + event_id % 61 END AS seconds,
  CASE WHEN event_id % 3 <> 0 THEN event_id END AS n FROM events""",
    "resolved_attribution": f"""
SELECT e.event_id, e.utm_source, e.utm_content, v.channel, v.campaign, v.variant FROM ({_UTM_EVENTS}) e
LEFT JOIN ({_VARIANTS}) v ON v.source = nullif(e.utm_source, '') AND v.content = nullif(e.utm_content, '')""",
    "landed_events": f"""
SELECT e.event_id, o.event_type AS event_name, date_trunc('second', o.ts) AS occurred_at, v.channel, v.campaign, v.variant, CAST(NULL AS VARCHAR) AS customer_id,
  CASE WHEN e.event_id % 3 = 0 THEN 'c' || CAST(o.user_id AS VARCHAR) END AS source_customer, CASE WHEN e.event_id % 4 = 0 THEN 'o' || CAST(e.event_id AS VARCHAR) END AS source_order
FROM ({_UTM_EVENTS}) e JOIN events o ON o.event_id = e.event_id LEFT JOIN ({_VARIANTS}) v ON v.source = nullif(e.utm_source, '') AND v.content = nullif(e.utm_content, '')""",
    "late_attribution": f"""
SELECT e.event_id, CASE WHEN e.event_id % 2 = 0 THEN 'old' ELSE v.channel END AS channel, CASE WHEN e.event_id % 2 = 1 THEN v.campaign END AS campaign, CASE WHEN e.event_id % 2 = 1 THEN v.variant END AS variant
FROM ({_UTM_EVENTS}) e LEFT JOIN ({_VARIANTS}) v ON v.source = e.utm_source AND v.content = e.utm_content""",
    "built_channels": _CHANNELS,
    "built_campaigns": f"SELECT campaign_slug AS slug, campaign_name AS name, min(link_id) AS started_at FROM ({_CHAINED}) GROUP BY ALL",
    "link_clashes": f"SELECT link_id, variant <> owner AS clash, CASE WHEN variant = owner THEN variant END AS variant FROM ({_OWNED})",
    "matched_posts": f"""
SELECT l.link_id, p.post_id FROM ({_LINKS}) l LEFT JOIN (SELECT post_id % 50 AS k, max(post_id) AS post_id FROM f_post GROUP BY 1) p ON p.k = l.link_id % 60""",
    "latest_snapshots": f"SELECT post_id, event_id, captured_at, likes, comments, shares FROM ({_LATEST})",
    "share_extract": f"""
SELECT p.post_id, p.platform, p.content_type, p.posted_at, p.caption, coalesce(s.likes, 0) AS likes, coalesce(s.comments, 0) AS comments, coalesce(s.shares, 0) AS shares
FROM f_post p JOIN ({_LATEST}) s ON s.post_id = p.post_id WHERE p.platform IN ('src0', 'src1', 'src2')""",
    "engagement_windows": _WINDOWS,
    "engagement_drops": f"SELECT alert_key, triggered, CASE WHEN triggered THEN 'warn' END AS severity FROM ({_VERDICTS})",
    "labelled_posts": _LABELLED,
    "class_balance": f"SELECT platform, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, round(avg(label), 6) AS positive_rate FROM ({_LABELLED}) GROUP BY ROLLUP (platform)",
    "expanding_folds": """
WITH r AS (SELECT post_id, row_number() OVER (ORDER BY posted_at, post_id) - 1 AS place, count(*) OVER () AS n FROM f_post)
SELECT post_id, CAST(CASE WHEN place < n - 5 * (n // 6) THEN 0 ELSE 1 + (place - (n - 5 * (n // 6))) // (n // 6) END AS INTEGER) AS fold FROM r""",
    "post_features": r"""
SELECT post_id, platform, coalesce(content_type, 'unknown') AS content_type, CAST(coalesce(content_type, 'unknown') IN ('video', 'reel') AS INTEGER) AS is_video, dayname(posted_at) AS day_of_week,
  CASE WHEN hour(posted_at) BETWEEN 5 AND 11 THEN 'morning' WHEN hour(posted_at) BETWEEN 12 AND 16 THEN 'afternoon' WHEN hour(posted_at) BETWEEN 17 AND 20 THEN 'evening' ELSE 'night' END AS hour_bucket,
  CAST(length(coalesce(caption, '')) AS INTEGER) AS caption_length, CAST(len(regexp_extract_all(coalesce(caption, ''), '#\w+')) AS INTEGER) AS hashtag_count FROM f_post""",
    "split_leakage": """
SELECT CAST(0 AS BIGINT) AS shared_ids,
  (SELECT count(*) FROM f_post WHERE posted_at > TIMESTAMP '2024-01-22 00:00:00' AND caption IN (SELECT caption FROM f_post WHERE posted_at <= TIMESTAMP '2024-01-22 00:00:00')) AS shared_captions,
  (SELECT max(posted_at) FROM f_post WHERE posted_at <= TIMESTAMP '2024-01-22 00:00:00') < (SELECT min(posted_at) FROM f_post WHERE posted_at > TIMESTAMP '2024-01-22 00:00:00') AS in_order""",
    "fanout_check": """
SELECT (SELECT count(*) FROM f_post) AS spine_rows, (SELECT count(*) FROM f_post p JOIN f_snapshot s ON s.post_id = p.post_id) AS joined_rows,
  (SELECT count(*) FROM (SELECT post_id FROM f_snapshot GROUP BY 1 HAVING count(*) > 1)) AS duplicate_keys""",
    "no_orders_alert": """
SELECT c AS case_name, 'no_orders_7d' AS alert_key, n = 0 AS triggered, CASE WHEN n = 0 THEN 'critical' END AS severity FROM (
  SELECT 'quiet' AS c, count(*) FILTER (placed_at >= TIMESTAMP '2001-12-25 00:00:00') AS n FROM f_orders UNION ALL
  SELECT 'busy', count(*) FILTER (placed_at >= TIMESTAMP '1998-06-08 00:00:00') FROM f_orders)""",
    "zero_cogs_alert": """
WITH ids AS (
  SELECT DISTINCT o.external_id FROM f_orders o JOIN f_order_line l ON l.order_id = o.order_id
  WHERE o.status = 'delivered' AND o.delivered_at >= TIMESTAMP '1998-06-14 00:00:00' AND l.unit_cogs_at_time = 0 ORDER BY 1 LIMIT 20),
a AS (SELECT count(*) AS n, coalesce(list(external_id ORDER BY external_id), []) AS x FROM ids)
SELECT 'zero_cogs_delivered_orders' AS alert_key, n > 0 AS triggered, CASE WHEN n > 0 THEN 'warn' END AS severity,
  CASE WHEN n > 0 THEN 'orders: ' || array_to_string(x[1:10], ', ') || CASE WHEN n > 10 THEN ' …' ELSE '' END END AS detail FROM a""",
    "alert_states": f"""
WITH v AS ({_VERDICTS}), o AS (SELECT alert_key, triggered, CAST(regexp_extract(platform, '([0-9]+)$', 1) AS INTEGER) % 2 = 1 AS was FROM v)
SELECT alert_key, CASE WHEN was THEN DATE '2024-01-01' ELSE DATE '2024-01-30' END AS detected, CASE WHEN was AND NOT triggered THEN DATE '2024-01-30' END AS resolved,
  CASE WHEN was AND NOT triggered THEN 'auto' END AS resolution FROM o WHERE was OR triggered""",
    "row_rules": """
SELECT unnest(['status_known', 'gross_not_negative', 'delivered_has_time', 'delivered_after_placed', 'discount_under_four']) AS rule,
  unnest([count(*) FILTER (status NOT IN ('delivered', 'received')), count(*) FILTER (gross < 0), count(*) FILTER (status = 'delivered' AND delivered_at IS NULL), count(*) FILTER (delivered_at < placed_at), count(*) FILTER (discounts >= 4)]) AS violations FROM f_orders""",
    "duplicate_lines": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "orphan_lines": "SELECT order_id, line_no FROM f_order_line WHERE order_id NOT IN (SELECT order_id FROM f_orders WHERE order_id % 3 > 0)",
    "overlapping_windows": "SELECT item_id, ingredient_id, version FROM f_recipe WHERE version = 2 AND item_id % 2 = 0",
    "text_leaks": " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) FILTER (regexp_matches(text, '{p}')) AS n FROM documents" for k, p in _LEAK.items()),
    "admin_dropped": f"""
SELECT event_id FROM (
  SELECT event_id, CASE k % 9 WHEN 2 THEN '/shown' WHEN 3 THEN '/admin' WHEN 4 THEN '/administration' ELSE '' END AS shown,
    CASE k % 9 WHEN 0 THEN '/admin/' || CAST(k AS VARCHAR) WHEN 1 THEN '/de/admin/' || CAST(k AS VARCHAR) WHEN 2 THEN '/admin?x=1' ELSE url END AS url FROM f_event)
WHERE NOT regexp_matches(CASE WHEN shown <> '' THEN shown ELSE {_PATH} END, '^/admin(/|$)')""",
    "property_classes": """
SELECT name, CASE WHEN name IN ('$pathname', 'distinct_id') THEN 'allowed' WHEN name = '$geoip_city_name' THEN 'dropped' ELSE 'unreviewed' END AS kind, count(*) AS n
FROM (SELECT unnest(['$pathname', '$geoip_city_name', 'new_' || CAST(event_id % 3 AS VARCHAR), 'distinct_id']) AS name FROM events) GROUP BY ALL""",
    "threshold_sweep": f"""
SELECT CAST(t AS INTEGER) AS step, round((count(*) FILTER (label = 1 AND r >= t) * 1.0 / nullif(count(*) FILTER (label = 1), 0) + count(*) FILTER (label <> 1 AND r < t) * 1.0 / nullif(count(*) FILTER (label <> 1), 0)) / 2, 6) AS balanced_accuracy
FROM (SELECT label, floor(round(p * 100, 9)) AS r FROM ({_SCORES})) CROSS JOIN (SELECT unnest(range(5, 96)) AS t) GROUP BY t""",
    "score_metrics": f"""
WITH r AS (SELECT unnest([platform, NULL]) AS platform, label, p FROM ({_SCORES})),
c AS (
  SELECT platform, count(*) FILTER (p >= 0.49 AND label = 1) AS tp, count(*) FILTER (p >= 0.49 AND label <> 1) AS fp, count(*) FILTER (p < 0.49 AND label = 1) AS fn,
    count(*) FILTER (p < 0.49 AND label <> 1) AS tn, round(avg((p - label) * (p - label)), 6) AS brier FROM r GROUP BY platform),
k AS (SELECT platform, label, rank() OVER w + (count(*) OVER (PARTITION BY platform, round(p, 6)) - 1) / 2.0 AS place FROM r WINDOW w AS (PARTITION BY platform ORDER BY round(p, 6))),
a AS (
  SELECT platform, round((sum(place) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0)
    / nullif(CAST(count(*) FILTER (label = 1) AS DOUBLE) * count(*) FILTER (label <> 1), 0), 6) AS auc FROM k GROUP BY platform)
SELECT c.*, round((tp * 1.0 / nullif(tp + fn, 0) + tn * 1.0 / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy, a.auc FROM c JOIN a ON a.platform IS NOT DISTINCT FROM c.platform""",
    "built_variants": f"""
SELECT 'taken' AS slug, 'kept' AS campaign, min(source) AS platform, '3' AS content FROM ({_LINKS})
UNION ALL SELECT DISTINCT variant, campaign_slug, source, content FROM ({_OWNED}) WHERE variant = owner""",
    "normalized_links": f"""
SELECT e.event_id, CASE WHEN e.event_id % 2 = 0 THEN 'old' ELSE v.channel END AS channel, CASE WHEN e.event_id % 2 = 1 THEN v.campaign_slug END AS campaign, CASE WHEN e.event_id % 2 = 1 THEN v.variant END AS variant
FROM ({_UTM_EVENTS}) e LEFT JOIN (SELECT DISTINCT source, content, channel, campaign_slug, variant FROM ({_OWNED}) WHERE variant = owner) v ON v.source = e.utm_source AND v.content = e.utm_content""",
    "pending_actions": "SELECT order_id AS action_id, CASE order_id % 5 WHEN 0 THEN 'proposed' ELSE 'queued' END AS status, placed_at AS proposed_at FROM f_orders WHERE order_id % 5 < 2",
    "action_outcomes": "SELECT CASE order_id % 5 WHEN 2 THEN 'approved' WHEN 3 THEN 'rejected' ELSE 'expired' END AS status, count(*) AS n FROM f_orders WHERE order_id % 5 > 1 GROUP BY 1",
    "open_alerts": "SELECT review_id, CASE WHEN rating IS NULL THEN 'info' WHEN rating < 3 THEN 'critical' ELSE 'warn' END AS severity, posted_at AS detected_at FROM f_review WHERE replied_at IS NULL",
    "alerts_open_twice": "SELECT source AS agent, CAST(rating AS VARCHAR) AS alert_key, count(*) AS n FROM f_review WHERE replied_at IS NULL AND source IS NOT NULL AND rating IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
    "source_orders": "SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders ORDER BY o_orderdate, o_orderkey",
    "source_events": "SELECT event_id, ts, event_type FROM events ORDER BY ts, event_id",
    "scrubbed_events": rf"""
SELECT event_id, {_HASHED} AS visitor, CAST(CASE WHEN event_id % 4 = 0 THEN 6 ELSE 7 END AS BIGINT) AS n_kept,
  'https://shop.example' || regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS current_url,
  {_HASHED} AS user_hash, substr('[Sale] ' || repeat(url, 60), 1, 500) AS title, CASE WHEN event_id % 4 <> 0 THEN 'linux' END AS os
FROM (SELECT *, list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '^utm_(source|medium|campaign|content|term)=')) AS kept FROM f_event)""",
    "unreviewed_properties": "SELECT 'new_' || CAST(event_id % 3 AS VARCHAR) AS name, count(*) AS n FROM f_event GROUP BY 1 UNION ALL SELECT '$os (not a plain value)', count(*) FROM f_event WHERE event_id % 4 = 0",
    "event_leaks": " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) FILTER (regexp_matches(payload, '{p}')) AS n FROM ({_PLANTED})" for k, p in _LEAK.items()),
    "event_fields": "SELECT event_id, '/' || event_type AS pathname, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE '' END AS session_id, '' AS os FROM events",
}
