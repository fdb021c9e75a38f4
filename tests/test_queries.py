"""Every registered query against its SQL on the smallest data folder."""

import pytest

from __spark_entry__ import entry
from check_queries import compare, connect
from skyraster.plans.oracles import oracle_sql
from skyraster.plans.registry import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    frame = queries()[name](spark, FOLDER)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    found = frame.toPandas()
    assert compare(found, duck.execute(oracle_sql()[name]).df()) == ""


def test_entry(spark):
    assert entry(spark).count() > 0
