"""Every registered query of the core against its SQL on the smallest data, and the contract of the entry module."""

import math
import os
from decimal import Decimal
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from skillweave import plans

DATA = os.environ.get("SKILLWEAVE_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float, Decimal)):
        return f"{float(value):.6g}"
    return str(value)


def table(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(plain(v) for v in row) for row in zip(*(frame[c].astype(object).tolist() for c in names), strict=True))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    found = table(plans.queries()[name](spark, DATA).toPandas())
    assert found == table(duck.execute(plans.oracle_sql()[name]).fetchdf())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_read_only_what_they_need(spark):
    plan = plans.queries()["package_redundancy"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema") :].split(">")[0]
    assert "skill_statement" in schema and "pcs_text" not in schema
    assert "PushedFilters: [IsNotNull(skill_statement)" in plan
