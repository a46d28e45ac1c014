"""Every registered query against its SQL on the smallest tables."""

import check
import pytest
from check import FOLDER

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return check.duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    left = check.spark_rows(QUERIES[name](spark, FOLDER))
    if name in ORACLES:
        found = check.difference(left, check.duck_rows(duck, ORACLES[name]))
        assert found is None, found
    else:
        assert left[1]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.limit(1).count() == 1
    assert frame.columns == entry.entry(spark).columns
