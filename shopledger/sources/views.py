"""The domain's tables as views over the given star schema.

One text serves both engines: braces name the tables that a view reads.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: The formulas that both sides agree on.
VIEWS = {
    "f_orders": """
        SELECT o_orderkey AS order_id, concat('ord_', CAST(o_orderkey AS STRING)) AS external_id, o_orderpriority AS channel,
          CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey END AS customer_id, o_orderdate AS placed_at,
          CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL '2' DAY END AS delivered_at,
          CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'received' ELSE 'cancelled' END AS status,
          CAST(o_totalprice AS DECIMAL(12,2)) AS gross, CAST(o_orderkey % 5 AS DECIMAL(12,2)) AS discounts,
          CAST(o_orderkey % 7 AS DECIMAL(12,2)) AS channel_fee, CAST(0.50 AS DECIMAL(12,2)) AS packaging_cost,
          CAST(o_orderkey % 3 AS DECIMAL(12,2)) AS delivery_cost,
          CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_totalprice AS DECIMAL(12,2)) END AS net_margin FROM {orders}""",
    "f_order_line": """
        SELECT order_id, line_no, item_id, qty, unit_price, unit_cogs_at_time FROM (
          SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS item_id, CAST(l_quantity AS DECIMAL(10,3)) AS qty,
            CAST(900 + l_partkey % 1000 AS DECIMAL(12,2)) AS unit_price, CAST(l_partkey % 200 AS DECIMAL(14,4)) AS unit_cogs_at_time,
            row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS rn
          FROM {lineitem}) d WHERE rn = 1""",
    "f_recipe": """
        SELECT item_id, ingredient_id, v AS version,
          CAST(v + (item_id + ingredient_id) % 9 AS DECIMAL(14,4)) AS qty,
          CAST(CASE WHEN (item_id + ingredient_id) % 2 = 0 THEN 1.0 ELSE 0.5 END AS DECIMAL(6,4)) AS yield_factor,
          CASE v WHEN 1 THEN TIMESTAMP '1990-01-01 00:00:00' ELSE TIMESTAMP '1998-01-01 00:00:00' END AS active_from,
          CASE v WHEN 1 THEN TIMESTAMP '1998-01-01 00:00:00' END AS active_to
        FROM (SELECT DISTINCT l_partkey AS item_id, l_suppkey AS ingredient_id FROM {lineitem}) p
        CROSS JOIN (SELECT 1 AS v UNION ALL SELECT 2 AS v) n""",
    "f_ingredient": """
        SELECT s_suppkey AS ingredient_id, lower(s_name) AS slug, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_nationkey END AS supplier_id,
          CAST(1 + s_suppkey % 20 AS DECIMAL(14,4)) AS current_price FROM {supplier}""",
    "f_menu_item": """
        SELECT p_partkey AS item_id, concat('part_', CAST(p_partkey AS STRING)) AS slug, p_name AS name_en, lower(p_type) AS category,
          CAST(p_retailprice AS DECIMAL(12,2)) AS current_price FROM {part}""",
    "f_event": """
        SELECT e.event_id, e.ts AS occurred_at, e.ts + INTERVAL '1' SECOND * (e.event_id % 120) AS arrived_at,
          CASE WHEN e.event_type = 'view' THEN '$pageview' ELSE e.event_type END AS event_name, e.user_id AS visitor,
          CASE WHEN e.event_id % 50 = 0 THEN NULL ELSE concat(CAST(e.user_id AS STRING), '-', CAST(CAST(e.ts AS DATE) AS STRING)) END AS session,
          e.value, e.k, p.url FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM {events}) e
        CROSS JOIN (SELECT count(*) AS n FROM {pages}) c JOIN {pages} p ON p.page_id = e.k % c.n""",
    "f_post": """
        SELECT doc_id AS post_id, source AS platform, lang AS content_type, text AS caption,
          TIMESTAMP '2024-01-30 12:00:00' - INTERVAL '1' HOUR * ((doc_id * 7) % 960) AS posted_at FROM {documents}""",
    "f_snapshot": """
        SELECT event_id % c.n AS post_id, event_id, ts AS captured_at, CAST(floor(value) AS BIGINT) AS likes,
          event_id % 7 AS comments, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 5 END AS shares
        FROM {events} CROSS JOIN (SELECT count(*) AS n FROM {documents}) c""",
    "f_ad_spend": """
        SELECT CAST(l_shipdate AS DATE) AS day, concat(l_returnflag, l_linestatus) AS platform, '__account__' AS campaign_id,
          sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS spend, sum(CAST(l_quantity AS BIGINT)) * 100 AS impressions,
          sum(CAST(l_quantity AS BIGINT)) AS clicks, sum(l_linenumber % 3) AS attributed_orders FROM {lineitem} GROUP BY 1, 2, 3""",
    "f_review": """
        SELECT d.doc_id AS review_id, d.source, d.text, CASE WHEN d.doc_id % 6 = 0 THEN NULL ELSE 1 + d.doc_id % 5 END AS rating,
          TIMESTAMP '2024-01-30 12:00:00' - INTERVAL '1' DAY * (d.doc_id % 60) AS posted_at,
          CASE WHEN l.quality = 1 THEN TIMESTAMP '2024-02-01 00:00:00' END AS replied_at FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id""",
}

#: The same rows for Spark alone, where its plan needs another wording. Events find their page by a number,
#: not through a cross join: of that the optimiser makes a loop of all events over all pages once a filter reads both.
#: Lines are dealt by order before repeats go, so that what groups or joins them by order next needs no second shuffle.
SPARK_VIEWS = VIEWS | {
    "f_event": """
        SELECT e.event_id, e.ts AS occurred_at, e.ts + INTERVAL '1' SECOND * (e.event_id % 120) AS arrived_at,
          CASE WHEN e.event_type = 'view' THEN '$pageview' ELSE e.event_type END AS event_name, e.user_id AS visitor,
          CASE WHEN e.event_id % 50 = 0 THEN NULL ELSE concat(CAST(e.user_id AS STRING), '-', CAST(CAST(e.ts AS DATE) AS STRING)) END AS session,
          e.value, e.k, p.url FROM (SELECT *, k % (SELECT nullif(count(*), 0) FROM {pages}) AS page FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM {events})) e
        JOIN {pages} p ON p.page_id = e.page""",
    "f_order_line": VIEWS["f_order_line"].replace("FROM {lineitem}", "FROM (SELECT /*+ REPARTITION(l_orderkey) */ * FROM {lineitem}) l"),
}


class Store:
    """The tables and views of one folder; each is read with only the columns a plan asks for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            text = SPARK_VIEWS[name]
            return self.spark.sql(text, **{t: self.table(t) for t in set(re.findall(r"\{(\w+)\}", text))})
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)


def with_views(sql: str) -> str:
    """``sql`` with the views that it names as common tables, for the other engine."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    heads = [f"{v} AS ({VIEWS[v].format(**{t: t for t in TABLES})})" for v in used]
    sql = sql.strip()
    if not heads:
        return sql
    if sql[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(heads) + ",\n" + sql[5:]
    return "WITH " + ",\n".join(heads) + "\n" + sql
