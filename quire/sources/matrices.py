"""Score and ground-truth matrices.

The canonical form is long: ``(query_id, candidate_id, score)`` and
``(query_id, candidate_id, label)``. A wide table ``(query_id, ARRAY)`` is
unpivoted with ``posexplode`` (position = candidate column). A 2-D ``.npy``
file on a shared file system is read in row ranges, one task per range, via
memory mapping: no task and no driver ever holds the whole matrix.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unpivot_rows(wide: DataFrame, row_id: str = "query_id", values: str = "scores", value_name: str = "score") -> DataFrame:
    return wide.select(row_id, F.posexplode(values).alias("candidate_id", value_name)).withColumn(
        "candidate_id", F.col("candidate_id").cast("bigint")
    )


def read_npy_matrix(
    spark: SparkSession, path: str, value_name: str = "score", rows_per_task: int = 1024, as_int: bool = False
) -> DataFrame:
    """Long ``(query_id, candidate_id, value)`` from a 2-D ``.npy``; the ground
    truth is cast to int (``as_int``) as the reference did."""
    shape = np.load(path, mmap_mode="r").shape  # header only
    if len(shape) != 2:
        raise ValueError(f"expected a 2-D matrix, got shape {shape}")
    n_rows, n_cols = int(shape[0]), int(shape[1])
    # a task reads at most about ten million cells, however wide the matrix
    rows_per_task = max(1, min(int(rows_per_task), 10_000_000 // max(1, n_cols)))
    n_tasks = max(1, math.ceil(n_rows / rows_per_task))
    vtype = T.LongType() if as_int else T.DoubleType()
    schema = T.StructType(
        [
            T.StructField("query_id", T.LongType()),
            T.StructField("candidate_id", T.LongType()),
            T.StructField(value_name, vtype),
        ]
    )

    def read(batches):
        m = np.load(path, mmap_mode="r")
        for pdf in batches:
            for t in pdf["id"].tolist():
                lo, hi = t * rows_per_task, min(n_rows, (t + 1) * rows_per_task)
                block = np.asarray(m[lo:hi])
                vals = block.astype(np.int64) if as_int else block.astype(np.float64)
                yield pd.DataFrame(
                    {
                        "query_id": np.repeat(np.arange(lo, hi, dtype=np.int64), n_cols),
                        "candidate_id": np.tile(np.arange(n_cols, dtype=np.int64), hi - lo),
                        value_name: vals.ravel(),
                    }
                )

    return spark.range(0, n_tasks, numPartitions=n_tasks).mapInPandas(read, schema)
