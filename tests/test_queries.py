"""Every registered query against its SQL; queries without SQL must give rows."""

import check
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
# Zero rows are right for these at the smallest scale.
MAY_BE_EMPTY = {"v9_visa_window", "k3_largest_regions"}


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    problem, n = check.compare(spark, duck, QUERIES[name], SQL.get(name), sf_dir)
    assert problem is None, problem
    assert n > 0 or name in MAY_BE_EMPTY


def test_entry(spark):
    assert entry.entry(spark).count() == 150
