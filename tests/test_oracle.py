"""Every registered query beside its SQL on the smallest tables."""

import compare
import pytest

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return compare.connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    assert compare.check(spark, con, QUERIES[name], ORACLE.get(name), small) == ""


def test_entry_has_rows_and_schema(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
