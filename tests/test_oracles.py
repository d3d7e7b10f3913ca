"""Every registered query of the core library against its SQL, on sf0.001."""

import pytest

from tracklark.queries import ORACLE_SQL, QUERIES

from .conftest import SF


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, same_rows, name):
    same_rows(QUERIES[name](spark, SF), duck.sql(ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
