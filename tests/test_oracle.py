"""Every registered query with an SQL twin agrees with it on the smallest tables."""

import pytest
from check_oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = queries()[name](spark, SF).toPandas()
    assert compare(got, duck.execute(oracle_sql()[name]).df()).startswith("ok")


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, name):
    assert queries()[name](spark, SF).columns


def test_entry(spark):
    assert entry(spark).count() == 15


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
