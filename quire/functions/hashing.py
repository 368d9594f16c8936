"""Deterministic, partition-independent randomness.

Every random choice is a pure function of ``(seed, tag, id)``: the same epoch
gives the same rows under any number of partitions or executors, and a
recomputed task after an executor loss draws exactly what it drew before.
``rand(seed)`` is not used because its stream depends on partition layout.

SQL form (DuckDB) of the same values, for oracles::

    md5(concat_ws('|', '<seed>', '<tag>', CAST(id AS VARCHAR)))
    ('0x' || substr(md5(...), 1, 15))::BIGINT
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_key(seed: int, tag: str, *ids) -> Column:
    """Hex md5 of ``seed|tag|id...``; compares like a 128-bit integer."""
    parts = [F.lit(str(int(seed))), F.lit(tag)] + [_as_col(i).cast("string") for i in ids]
    return F.md5(F.concat_ws("|", *parts))


def hash_int(seed: int, tag: str, *ids) -> Column:
    """First 60 bits of :func:`hash_key` as a non-negative BIGINT."""
    return F.conv(F.substring(hash_key(seed, tag, *ids), 1, 15), 16, 10).cast("bigint")


def hash_key_sql(seed: int, tag: str, id_sql: str) -> str:
    return f"md5(concat_ws('|', '{int(seed)}', '{tag}', CAST({id_sql} AS VARCHAR)))"


def hash_int_sql(seed: int, tag: str, id_sql: str) -> str:
    return f"('0x' || substr({hash_key_sql(seed, tag, id_sql)}, 1, 15))::BIGINT"
