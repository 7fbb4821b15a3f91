"""Every query with an SQL twin, against DuckDB on the smallest tables; plan checks on the rest."""

from __future__ import annotations

from pathlib import Path

import pytest

from bindings import REGISTRY
from conftest import plan_of
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if sql])
def test_equals_twin(spark, duck, name):
    fn, sql = REGISTRY[name]
    assert compare(fn(spark, SF), duck, sql) is None


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in REGISTRY if n[0] in "fnpg" or n.startswith(("k10", "k3", "j", "o", "u"))])
def test_no_python_on_the_row_path(spark, name):
    plan = plan_of(REGISTRY[name][0](spark, SF))
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("name", ["n3_rate_of_change", "n6_rolling_std", "n9_idle_runs", "n11_driving_style_latch"])
def test_one_shuffle_and_one_sort_per_series_job(spark, name):
    plan = plan_of(REGISTRY[name][0](spark, SF))
    assert plan.count("Exchange") == 1 and plan.count(" Sort ") == 1


def test_filters_and_columns_reach_the_scan(spark):
    import bindings.base as base
    from torqueline.operators.rows import range_filter

    df = range_filter(base.table(spark, SF, "events").select("event_id", "value"), {"value": (10, 100)})
    text = spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(value,10.0)" in text and "ReadSchema: struct<event_id:bigint,value:double>" in text
