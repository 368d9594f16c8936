"""Physical-plan checks: no query plans a cross product, the top-2 and top-k
windows run a partial limit before the shuffle, and scans read only the
columns they need."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from quire.plans.registry import QUERIES
from quire.sources import fixtures as fx
from tests.conftest import SF0001


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_products(spark, name):
    plan = _plan(E.queries()[name](spark, SF0001))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_top_two_limits_before_the_shuffle(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from quire.plans.pairs import side_rank

    docs = fx.fx_orders_docs(spark, SF0001)
    w = Window.partitionBy("author_id").orderBy(side_rank(), F.col("seq"), F.col("doc_id"))
    plan = _plan(docs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 2))
    import re

    # formatted plans number operators bottom-up: a smaller id runs earlier
    partial = [int(m.group(1)) for m in re.finditer(r"\((\d+)\) WindowGroupLimit\nInput[^\n]*\nArguments: [^\n]*Partial", plan)]
    exchanges = [int(m.group(1)) for m in re.finditer(r"\((\d+)\) Exchange\n", plan)]
    assert partial and exchanges
    assert min(partial) < min(exchanges)


def test_fixture_scans_prune_columns(spark):
    plan = _plan(fx.fx_orders_docs(spark, SF0001).select("author_id", "doc_id"))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan
    plan = _plan(fx.fx_queries(spark, SF0001))
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>,label:int>" in plan
