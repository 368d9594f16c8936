"""Queries that SQL can express, against DuckDB on sf0.001; and the pipeline
on top of the entry module."""

import pytest

import __spark_entry__ as E
from quire.llm.queries import ORACLE, QUERIES
from tests.conftest import SF0001
from tools.oracle_check import duck, rows_key


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    df = E.queries()[name](spark, SF0001)
    res = duck(SF0001).execute(ORACLE[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_key([tuple(r) for r in df.collect()], df.columns) == rows_key(res.fetchall(), cols)


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(E.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
