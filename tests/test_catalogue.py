"""Every registered query against its SQL in the other engine."""

import duckdb
import pytest

from shopledger.plans import catalogue
from shopledger.sources.views import TABLES

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def other():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query(spark, other, name, tmp_path):
    QUERIES[name](spark, FOLDER).write.parquet(f"{tmp_path}/out")
    other.execute(f"CREATE OR REPLACE TEMP TABLE want AS {SQL[name]}")
    other.execute(f"CREATE OR REPLACE TEMP TABLE got AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    columns = sorted(r[0] for r in other.execute("DESCRIBE want").fetchall())
    assert sorted(r[0] for r in other.execute("DESCRIBE got").fetchall()) == columns
    names = ", ".join(f'"{c}"' for c in columns)
    for a, b in (("want", "got"), ("got", "want")):
        assert other.execute(f"SELECT {names} FROM {a} EXCEPT ALL SELECT {names} FROM {b} LIMIT 3").fetchall() == []


def test_all_have_sql():
    assert set(SQL) == set(QUERIES)


def test_pseudonyms_are_hmacs(spark):
    import hashlib
    import hmac

    rows = catalogue.queries()["pseudonyms"](spark, FOLDER).collect()
    users = {r["event_id"]: r["user_id"] for r in spark.read.parquet(f"{FOLDER}/events.parquet").select("event_id", "user_id").collect()}
    for r in rows[:50]:
        assert r["visitor"] == "ph_" + hmac.new(catalogue.SALT, str(users[r["event_id"]]).encode(), hashlib.sha256).hexdigest()[:32]


@pytest.mark.parametrize("name", ["true_margin", "unit_cogs_at", "web_acquisition_daily", "labelled_posts", "resolved_attribution"])
def test_plans_have_no_python_and_no_nested_loop_of_tables(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "CartesianProduct" not in plan
