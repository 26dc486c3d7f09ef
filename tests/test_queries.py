"""Every query of the core with SQL, held against DuckDB on the same tables."""

import pytest
from conftest import same_rows

from phonospark.plans import queries as q


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query_equals_sql(name, spark, sf, duck):
    same_rows(q.QUERIES[name](spark, sf), duck.sql(q.ORACLE_SQL[name]))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
