"""Every registered query with SQL gives the rows that the SQL gives."""

import pytest

from helpers import SF, rows_of
from lodestrata import plans  # noqa: F401
from lodestrata.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    mine = rows_of(registry.QUERIES[name](spark, SF).toPandas())
    theirs = rows_of(duck.execute(registry.SQL[name]).df())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_other_queries_run(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
