"""Plans and steps whose work must not grow faster than their tables."""

import pytest
from pyspark.sql import functions as F

from shopledger.operators import privacy
from shopledger.plans import catalogue
from shopledger.sources.views import VIEWS, Store

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["admin_dropped", "unreviewed_properties", "scrubbed_events", "web_traffic_daily"])
def test_events_find_their_page_by_a_key(spark, name):
    plan = plan_of(catalogue.queries()[name](spark, FOLDER))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_events_are_those_of_the_shared_text(spark, tmp_path):
    s = Store(spark, FOLDER)
    same = spark.sql(VIEWS["f_event"], events=s.events, pages=s.pages)
    assert s.f_event.schema == same.schema and s.f_event.count() == same.count() > 0
    assert s.f_event.exceptAll(same).count() == same.exceptAll(s.f_event).count() == 0
    s.events.write.parquet(f"{tmp_path}/events.parquet")
    s.pages.limit(0).write.parquet(f"{tmp_path}/pages.parquet")
    assert Store(spark, str(tmp_path)).f_event.count() == 0

def test_names_are_counted_from_payloads_parsed_once(spark):
    raw = spark.createDataFrame([(1, '{"zzz": 1, "$ip": "x"}'), (2, "{}"), (3, None), (4, "no object"), (5, '{"zzz": null}')], "id int, payload string")
    got = privacy.classify_keys(raw.select(privacy.typed_properties(F.col("payload")).alias("properties")))
    assert plan_of(got).count("from_json") == 1
    assert sorted(map(tuple, got.collect())) == [("$ip", "dropped", 1), ("zzz", "unreviewed", 2)]


def test_lines_by_order_cross_one_shuffle(spark):
    s = Store(spark, FOLDER)
    plan = plan_of(s.f_order_line.groupBy("order_id").agg(F.collect_list("item_id").alias("items")))
    assert plan.count("Exchange hashpartitioning") == 1
    same = spark.sql(VIEWS["f_order_line"], lineitem=s.lineitem)
    assert s.f_order_line.schema == same.schema and s.f_order_line.exceptAll(same).count() == same.exceptAll(s.f_order_line).count() == 0


@pytest.mark.parametrize("name", ["landed_orders", "landed_order_lines"])
def test_landed_payloads_are_parsed_once(spark, name):
    plan = plan_of(catalogue.queries()[name](spark, FOLDER))
    assert "from_json" not in plan and "to_json" not in plan  # the check of skus has had them parsed and written
