"""Every query with SQL gives the SQL's rows."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from bazaarflow.plans.queries import QUERIES, oracles  # noqa: E402

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
SAMPLE = ("kpi_block", "revenue_month_city", "rfm", "pareto_parts", "std_phone", "std_date", "cleanse_products", "parse_sales", "fact_sales", "survivors", "scd2_asof", "trade_area", "distinct_events", "sliding_24h")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(v):
    if v is None:
        return "-"
    return f"{float(v):.6g}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, name):
    base = duckdb.connect()
    base.execute("set TimeZone='UTC'")
    for t in TABLES:
        base.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = QUERIES[name](spark, DATA)
    found = base.execute(oracles()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(tuple(map(plain, r)) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in names) for r in got.collect()) == want


def test_plans_have_no_cross_join(spark):
    for name in ("kpi_block", "fact_sales", "trade_area", "denormalised"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Cross" not in plan, name
