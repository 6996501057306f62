"""Every registered query against its SQL, and what no plan may hold."""

import pytest

import __spark_entry__ as entry_module
from townbill.bindings import registry
from compare import compare, duck
from helpers import plan_of

SF = "/root/testdata/sf0.001"
entry_module.queries()
QUERIES, SQL = registry.QUERIES, registry.ORACLES


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, SF, QUERIES[name], SQL[name]) is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    for step in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
        assert step not in plan


def test_entry(spark):
    assert entry_module.entry(spark).count() == 1


def test_top_n_is_taken_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan_of(QUERIES["item_positions"](spark, SF))


def test_scans_read_only_their_columns(spark):
    plan = plan_of(QUERIES["weekly_active"](spark, SF))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan and "In(event_type" in plan
