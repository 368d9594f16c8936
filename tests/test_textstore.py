import os

import pytest
from pyspark.sql import functions as F

from quire.operators.textstore import n_buckets, stored_texts
from quire.plans import pairs as P
from quire.plans.registry import _resolved
from tests.conftest import SF001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_epochs_read_texts_in_place_and_get_the_same_rows(spark, no_broadcast):
    docs = _resolved(spark, SF001)
    with stored_texts(docs, buckets=5) as texts:
        for epoch in (1, 2):
            rows = P.build_cross_role_pairs(docs, "train", epoch, strict=False).rows
            looked_up = P.attach_texts(rows, texts)
            assert "SelectedBucketsCount: 5 out of 5" in _plan(looked_up)
            # the plain join shuffles the documents by id, the store does not
            exchanges = [_plan(x).count("Exchange hashpartitioning(d#") for x in (P.attach_texts(rows, docs), looked_up)]
            assert exchanges == [2, 1]
            assert sorted(map(tuple, looked_up.collect())) == sorted(map(tuple, P.attach_texts(rows, docs).collect()))


def test_the_table_and_its_files_are_gone_afterwards(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, "c"), (1, "a")], "doc_id long, full_text string")
    with pytest.raises(KeyError):
        with stored_texts(docs) as texts:
            assert sorted(texts.collect()) == [(1, "a"), (1, "a"), (2, None)]
            folder = os.path.dirname(texts.inputFiles()[0].removeprefix("file://"))
            assert os.path.isdir(folder)
            raise KeyError
    assert not os.path.exists(folder)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("texts_")]


def test_buckets_grow_with_the_text(spark):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é"), 500).alias("full_text"))
    assert n_buckets(docs, bucket_bytes=10_000) == 10
    assert n_buckets(docs.limit(0)) == spark.sparkContext.defaultParallelism
