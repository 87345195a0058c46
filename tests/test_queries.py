"""Every query with SQL gives the same rows as DuckDB; every other one runs."""

import pytest

from stratalog import change_queries, queries, tree_queries  # noqa: F401
from tests.oracle import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    query, sql = queries.queries()[name], queries.oracle_sql().get(name)
    if sql:
        assert not differences(spark, query, sql, SF)
    else:
        assert query(spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert {*e.oracle_sql()} <= {*e.queries()}
