"""Every registered query against its SQL on the smallest tables."""

import pytest

from tests.oracle import connect, differences
from voxtab.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert name in ORACLE_SQL
    assert differences(df, con, ORACLE_SQL[name]) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 9
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())
