import pytest

from __spark_entry__ import entry
from checks.queries import QUERIES
from checks.sql import SQL

from .oracle import differences

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert differences(spark, QUERIES[name], SQL[name], SF_DIR) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    assert entry(spark).count() > 0
