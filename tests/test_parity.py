"""Every registered query with SQL equals it on DuckDB. PARITY_SF picks the data (default sf0.001)."""

import os

import parity
import pytest

import __spark_entry__ as entry

FOLDER = f"/root/testdata/sf{os.environ.get('PARITY_SF', '0.001')}"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return parity.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    assert parity.difference(entry.queries()[name](spark, FOLDER), con, ORACLES[name]) is None


def test_every_query_without_sql_is_known():
    from docketflow.plans import catalog
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
