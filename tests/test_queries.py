"""Every registered query against its SQL counterpart, over the smallest tables."""

import pytest

import __spark_entry__ as entry_module
from oracle import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES = entry_module.queries()
ORACLES = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    """All but the text operators, whose own tests compare those without SQL with a brute-force version."""
    assert set(entry_module.TABLE_QUERIES) <= set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and df.columns[0] == "Timestamp"


@pytest.mark.parametrize("name", sorted(entry_module.TABLE_QUERIES))
def test_query_matches_sql(spark, con, name):
    assert compare(con, spark, name, QUERIES[name], ORACLES[name], SF) is None
