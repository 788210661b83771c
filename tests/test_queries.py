"""Every query against its DuckDB form."""

import pytest

from tessera.plans import catalog, library  # noqa: F401
from tests.conftest import rows_of


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    if name in catalog.ORACLE:
        want = duck.execute(catalog.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)
    assert len(got)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_plans_push_down(spark, sf):
    plan = library.q_weighted_loss(spark, sf)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_quantity:double,l_discount:double>" in plan
    plan = library.q_neighbors(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoopJoin" not in plan
