import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions.vectors import cosine, dot, l2_normalize, np_stack


def test_column_vector_functions(spark):
    rows = [([1.0, 2.0, 2.0], [2.0, 0.0, 1.0]), ([0.0, 0.0, 0.0], [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = df.select(
        dot("a", "b").alias("d"), cosine("a", "b").alias("c"), l2_normalize("a").alias("n")
    ).collect()
    assert got[0]["d"] == pytest.approx(4.0)
    assert got[0]["c"] == pytest.approx(4.0 / (3.0 * np.sqrt(5.0)))
    assert got[0]["n"] == pytest.approx([1 / 3, 2 / 3, 2 / 3])
    assert got[1]["c"] == 0.0 and got[1]["n"] == [0.0, 0.0, 0.0]


def test_float_arrays_are_widened(spark):
    df = spark.createDataFrame([([1.0, 1.0],)], "a array<float>")
    assert df.select(F.round(cosine("a", "a"), 12).alias("c")).first()["c"] == 1.0


def test_null_vectors_are_zero():
    assert np_stack([None, np.array([1.0, 2.0]), None]).tolist() == [[0, 0], [1, 2], [0, 0]]
    assert np_stack([None, None]).shape == (2, 0) and np_stack([]).shape == (0, 0)
