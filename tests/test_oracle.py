"""Every registered query against its DuckDB oracle on sf0.001 (the driver
repeats this at sf0.01)."""

import pytest

import __spark_entry__ as E
from quire.plans.registry import ORACLE, QUERIES
from tests.conftest import SF0001
from tools.oracle_check import duck, rows_key

# the training-data operators have their own tests
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF0001)


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES) and set(QUERIES) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF0001)
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert rows_key(srows, df.columns) == rows_key(drows, dcols)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 1
    assert df.columns == ["n_queries", "n_undefined", "mean_eer", "mean_ap"]
