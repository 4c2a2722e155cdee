"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
import check

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small_dir):
    return check.connect(small_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, small_dir, name):
    found = check.compare(spark, con, small_dir, QUERIES[name], ORACLES[name])
    assert found in (None, "no rows")


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_flagship(spark):
    df = entry.entry(spark)
    assert {"alert_id", "severity", "deduplicated"} <= set(df.columns)
    assert df.count() > 0
