"""Every query with SQL gives what that SQL gives."""

import pytest
from compare import rows, tables

from tillage import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if name in SQL:
        assert rows(got) == rows(tables(sf_dir).sql(SQL[name]).df())
