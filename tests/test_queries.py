import pytest

import __spark_entry__
from oracle import same
from paraloom import queries

ROWS_ONLY = [n for n in queries.QUERIES if n not in queries.SQL]


@pytest.mark.parametrize("name", list(queries.SQL))
def test_matches_sql(spark, small, name):
    same(spark, name, queries.QUERIES[name], queries.SQL[name], small)


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(spark, small, name):
    assert queries.QUERIES[name](spark, small).count() >= 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
