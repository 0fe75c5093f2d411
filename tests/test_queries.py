"""Every query against its SQL twin, and the shape of its plan."""

import __spark_entry__ as driver
import oracle
import pytest

from taskatlas.plans.catalog import ORACLES, QUERIES
# Queries without an SQL form are checked in the other test modules.
NO_SQL = {"v13_approximate_top_k", "v14_pca"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name in ORACLES:
        assert oracle.differences(df, con, ORACLES[name]) == []
    else:
        assert name in NO_SQL
        assert df.count() > 0


def test_names_agree():
    assert set(ORACLES) == set(QUERIES) - NO_SQL
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["soc_code", "title", "ai_category", "year", "exposure"]
    assert df.count() > 0


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = plan_of(QUERIES["f7_importance"](spark, sf_dir))
    assert "PushedFilters" in plan and "PROMO" in plan.split("PushedFilters", 1)[1]
    read = [part.split(">", 1)[0] for part in plan.split("ReadSchema: struct<")[1:]]
    assert any("l_partkey" in r and "l_extendedprice" not in r for r in read)


def test_top_k_limits_before_the_shuffle(spark, sf_dir):
    plan = plan_of(QUERIES["d2_keep_first"](spark, sf_dir))
    assert plan.count("WindowGroupLimit") == 2
