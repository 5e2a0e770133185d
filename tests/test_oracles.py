"""Every registered query against its DuckDB twin (the correctness gate), on sf0.001."""

import pytest

import __spark_entry__ as E
from tools.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
ORACLES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", ORACLES)
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(spark, con, name, SF, E.queries(), E.oracle_sql())
    assert ok, msg


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "interpretation_label" in df.columns
