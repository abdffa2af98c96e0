"""Every query with SQL gives the same rows as DuckDB; the others give rows."""

import pytest

from brightwell.plans.catalog import ORACLE_SQL, QUERIES

from .conftest import DATA
from .oracle import compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    if name in ORACLE_SQL:
        compare(df, con, ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_entry_has_all(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
