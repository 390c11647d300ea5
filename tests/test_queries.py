"""Every registered query against its SQL, at the smallest size."""

import pytest
from oracle import same

from quern.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, tables, name):
    same(QUERIES[name](spark, tables), SQL[name], tables)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_rows_only(spark, tables, name):
    assert QUERIES[name](spark, tables).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert __spark_entry__.queries().keys() >= QUERIES.keys()
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
