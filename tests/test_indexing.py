import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.operators.indexing import dense_index, grouped_running_sums


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_dense_index_matches_row_number(spark, parts):
    rng = np.random.default_rng(parts)
    keys = rng.permutation(500)
    df = spark.createDataFrame(pd.DataFrame({"k": keys.astype("int64"), "v": rng.normal(size=500)}))
    out = dense_index(df, ["k"], out="idx", num_partitions=parts).toPandas()
    assert sorted(out["idx"]) == list(range(500))
    assert (out["idx"] == out["k"]).all()


def _reference(pdf):
    pdf = pdf.sort_values(["g", "o"], ascending=[True, False]).reset_index(drop=True)
    g = pdf.groupby("g", sort=False)
    pdf["gpos"] = g.cumcount()
    pdf["cum_x"] = g["x"].cumsum().astype(float)
    pdf["next_x"] = g["x"].shift(-1)
    pdf["total_x"] = g["x"].transform("sum").astype(float)
    pdf["group_rows"] = g["x"].transform("size")
    return pdf


@pytest.mark.parametrize("parts", [1, 5, 13])
def test_grouped_running_sums_hot_group(spark, parts):
    """One group holds a third of the rows and spans many partitions; Arrow
    batches are tiny so groups also cross batch boundaries."""
    rng = np.random.default_rng(7)
    n = 900
    g = np.where(np.arange(n) < n // 3, 0, rng.integers(1, 40, n))
    pdf = pd.DataFrame({"g": g.astype("int64"), "o": rng.permutation(n).astype("int64"), "x": rng.integers(0, 5, n).astype("int64")})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        out = grouped_running_sums(
            spark.createDataFrame(pdf), ["g"], [F.col("o").desc()], ["x"], num_partitions=parts, leads=["x"], totals=True
        ).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    ref = _reference(pdf)
    m = ref.merge(out, on=["g", "o"], suffixes=("_r", "_s"))
    assert len(m) == n
    assert (m["gpos_r"] == m["gpos_s"]).all()
    assert np.allclose(m["cum_x_r"], m["cum_x_s"])
    assert np.allclose(m["total_x_r"], m["total_x_s"])
    assert (m["group_rows_r"] == m["group_rows_s"]).all()
    both_null = m["next_x_r"].isna() & m["next_x_s"].isna()
    assert (both_null | (m["next_x_r"] == m["next_x_s"])).all()


def test_grouped_running_sums_null_group_is_one_group(spark):
    pdf = pd.DataFrame({"g": [None, None, "a", "a", None], "o": [1, 2, 3, 4, 5], "x": [1, 1, 1, 1, 1]})
    df = spark.createDataFrame(pdf, "g string, o bigint, x bigint")
    out = grouped_running_sums(df, ["g"], ["o"], ["x"], num_partitions=3, totals=True).toPandas()
    assert len(out) == 5
    nulls = out[out.g.isna()].sort_values("o")
    assert nulls["gpos"].tolist() == [0, 1, 2] and nulls["total_x"].tolist() == [3.0] * 3
