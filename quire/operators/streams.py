"""Groups of bounded size against streams of any length.

A cell holds a bounded number of rows (phase 0) while the rows of the other
side pass by, a batch at a time and as often as there are later phases. Rows
are dealt by cell and sorted by (cell, phase), so the held rows come first and
no task ever has the passing side in memory. A passing row is copied once per
cell and phase; how many cells there are follows from the cores and from what
a cell may hold, not from the number of passing rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.functions.vectors import np_stack

#: Entries of a matrix that a kernel makes at once (32 MB of doubles).
TILE = 1 << 22
#: Rows that a cell holds at most.
HELD_ROWS = 1 << 14

Phases = Iterator[tuple[int, Iterator[pa.RecordBatch]]]


def n_cells(rows: int, cores: int, held_rows: int = HELD_ROWS) -> int:
    """Cells for ``rows`` held rows: one per core, more if one held too many."""
    return max(1, min(rows, max(cores, -(-rows // held_rows))))


def tiles(n: int, width: int, most: int = TILE) -> Iterator[slice]:
    """Slices of ``n`` rows whose products with ``width`` rows fit a tile."""
    step = max(1, most // max(1, width))
    return (slice(i, min(n, i + step)) for i in range(0, n, step))


def vectors(column: pa.Array) -> np.ndarray:
    """A list column as a matrix, as :func:`np_stack` does."""
    flat, n = column.flatten(), len(column)
    if n and not column.null_count and not flat.null_count and len(flat):
        ends = np.asarray(column.value_lengths())
        if (ends == ends[0]).all():
            return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(n, -1)
    return np_stack(column.to_pylist())


def matching(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of unit vectors; 0 where a side holds null vectors only."""
    if a.shape[1] != b.shape[1] and 0 in (a.shape[1], b.shape[1]):
        return np.zeros((len(a), len(b)))
    return a @ b.T


def whole(batches: Iterator[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(list(batches)).combine_chunks().to_batches()[0]


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
    """(cell, phase, rows) of neighbouring rows alike, at most a batch each."""
    for batch in batches:
        if batch.num_rows:
            keys = batch.select(names).to_pandas()
            first = np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy())
            for a, b in zip(first, [*first[1:], batch.num_rows]):
                *cell, phase = (keys[n].iloc[a] for n in names)
                yield tuple(cell), int(phase), batch.slice(a, b - a)


def pass_by(held: DataFrame, passing: DataFrame, cell: Sequence[str], n: int, kernel: Callable[[tuple, Phases], Iterator[pd.DataFrame | pa.RecordBatch]], schema: T.StructType | str, phases: int = 1) -> DataFrame:
    """``kernel(cell, phases)`` for every cell, whose columns ``cell`` are not
    null; ``phases`` gives (phase, batches): 0 and the held rows, if any, then
    1 and on with the passing rows, each time all of them. A single integer
    column counts cells from 0 to ``n`` - 1."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow, names = to_arrow_schema(schema), [*cell, "_phase"]
    again = F.explode(F.sequence(F.lit(1), F.lit(phases))) if phases > 1 else F.lit(1)
    rows = held.withColumn("_phase", F.lit(0)).unionByName(passing.withColumn("_phase", again), allowMissingColumns=True)
    if len(cell) == 1 and isinstance(rows.schema[cell[0]].dataType, T.IntegerType):
        dealt = rows.repartitionById(n, F.col(cell[0]))
    else:
        dealt = rows.repartition(n, *cell)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, some in groupby(_runs(batches, names), key=lambda x: x[0]):
            by_phase = ((phase, (r for _, _, r in same)) for phase, same in groupby(some, key=lambda x: x[1]))
            for out in kernel(key, by_phase):
                if len(out):
                    yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False)

    return dealt.sortWithinPartitions(*names).mapInArrow(run, schema)


def dealt_to_all(passing: DataFrame, cell: str, n: int) -> DataFrame:
    """Every row, once per cell."""
    return passing.withColumn(cell, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
