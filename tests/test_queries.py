"""Every query of the engine against its SQL."""

import pytest

import __spark_entry__ as entry
from tessera.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(same, name):
    same(QUERIES[name], ORACLES[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_push_down(spark):
    """A key predicate and the columns read reach the scan."""
    plan = QUERIES["pk_point_get"](spark, "/root/testdata/sf0.001").select("o_custkey")._jdf.queryExecution().toString()
    assert "EqualTo(o_orderkey,7)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan
    assert "TakeOrderedAndProject" in QUERIES["top_k"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
