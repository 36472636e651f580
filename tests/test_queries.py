"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from tests.compare import DATA, compare
from workload import registered

QUERIES, SQL = registered()
SF = os.path.join(DATA, os.environ.get("TEST_SF", "sf0.001"))


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, key):
    if key in SQL:
        assert compare(spark, key, QUERIES[key], SQL[key], SF) is None
    else:
        assert QUERIES[key](spark, SF).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
