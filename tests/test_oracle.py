"""Every named query with SQL gives the same columns, types and values as that SQL."""

import pytest

from compare import connect, differences, spark_side, sql_side
from conftest import SF_SMALL
from glossaframe.plans import QUERIES, SQL


@pytest.fixture(scope="module")
def con():
    return connect(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    result = spark_side(QUERIES[name](spark, SF_SMALL))
    if name in SQL:
        assert differences(result, sql_side(con, SQL[name])) is None
    else:
        assert result[1]


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["kind", "n"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
