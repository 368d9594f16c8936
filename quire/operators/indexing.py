"""Ordered positions and running sums that stay distributed.

``row_number()`` without PARTITION BY and a per-key window both put one key
(or the whole table) into one task. These helpers instead:

1. range-partition on the sort key and sort inside each partition;
2. number rows locally per partition (partition id and monotonic id);
3. write that result once as a table under ``spark.checkpoint.dir``, so
   the layout-dependent numbers are fixed columns from then on;
4. add offsets from a per-partition (or per partition-and-group) summary;
   running sums use windows over (partition, group) segments, each bounded
   by one range partition.

The summary has at most one row per partition (plus one per group that a
partition holds), so the broadcast of offsets is bounded by the partition
count, not by the data. A group spread over many partitions — a hot key with
a third of all rows — is handled exactly like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import stable


def _range(df: DataFrame, exprs: list, num_partitions: int | None) -> DataFrame:
    """Range-partition and sort. Without an explicit count the exchange is
    planned like a ``repartition(col)``: AQE may merge neighbouring ranges to
    its advisory partition size, which keeps the order and fits the count to
    the data (a handful for a small table, thousands for a large one)."""
    if num_partitions:
        ranged = df.repartitionByRange(int(num_partitions), *exprs)
    else:
        ranged = df.repartitionByRange(*exprs)
    return ranged.sortWithinPartitions(*exprs)


def _order_exprs(order: Sequence) -> list:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def dense_index(
    df: DataFrame, order: Sequence, out: str = "idx", num_partitions: int | None = None
) -> DataFrame:
    """Add ``out`` = 0-based position of each row in the total order ``order``.

    ``order`` must be a total order (unique keys), otherwise ties are numbered
    in an arbitrary order, fixed once the numbered table is written.
    """
    exprs = _order_exprs(order)
    ranged = _range(df, exprs, num_partitions)
    local = ranged.withColumn("_pid", F.spark_partition_id()).withColumn(
        "_lidx",
        F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("bigint"), 33),
    )
    local = stable(local)
    per_part = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = per_part.select(
        "_pid",
        F.coalesce(
            F.sum("_cnt").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_off"),
    )
    return (
        local.join(F.broadcast(offsets), "_pid")
        .withColumn(out, (F.col("_off") + F.col("_lidx")).cast("bigint"))
        .drop("_pid", "_lidx", "_off")
    )


# offsets of file splits: about 200 bytes a row, so at most some 20 MB
BROADCAST_SPLITS = 100_000


def split_index(df: DataFrame, split: Sequence[str], row: str, out: str = "idx") -> DataFrame:
    """Add ``out`` = 0-based position of each row in the order (``split``,
    ``row``), for rows that a file scan already delivers in order.

    ``row`` is ``monotonically_increasing_id()`` taken at the scan and
    ``split`` names a file split (path and start), so the rows of a split are
    one run of ``row``. The rows are written once where they are, which fixes
    these numbers; only one row per split (first id, count) is shuffled and
    ordered, and no text is. The offsets are broadcast when there are at most
    ``BROADCAST_SPLITS`` of them, otherwise joined. When a later filter left
    gaps in a split, the positions come from :func:`dense_index`.
    """
    split = list(split)
    rows = stable(df)
    per_split = stable(
        rows.groupBy(*split).agg(
            F.min(row).alias("_first"), F.max(row).alias("_last"), F.count(F.lit(1)).alias("_cnt")
        )
    )
    shape = per_split.agg(
        F.count(F.lit(1)).alias("splits"),
        F.count_if(F.col("_last") - F.col("_first") + 1 != F.col("_cnt")).alias("gaps"),
    ).first()
    if shape["gaps"]:
        return dense_index(rows, [*split, row], out=out)
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_split.select(
        *[F.col(c).alias(f"_k_{c}") for c in split],
        (F.coalesce(F.sum("_cnt").over(before), F.lit(0)) - F.col("_first")).alias("_off"),
    )
    if int(shape["splits"]) <= BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    same = [rows[c].eqNullSafe(F.col(f"_k_{c}")) for c in split]
    return (
        rows.join(offsets, same)
        .withColumn(out, (F.col("_off") + F.col(row)).cast("bigint"))
        .drop("_off", *[f"_k_{c}" for c in split])
    )


def grouped_running_sums(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence,
    sums: Sequence[str],
    num_partitions: int | None = None,
    pos_col: str = "gpos",
    leads: Sequence[str] = (),
    totals: bool = False,
) -> DataFrame:
    """Per group, in ``order``: 0-based position ``pos_col`` and the running
    (inclusive) sum ``cum_<c>`` of each column in ``sums``.

    ``leads`` adds ``next_<c>``, the value of ``c`` on the next row of the
    same group (NULL on its last row); ``totals`` adds ``group_rows`` and
    ``total_<c>`` for the whole group.

    Skew-proof: rows are range-partitioned on (group, order) and numbered
    inside each range partition; the windows then run per (partition, group)
    segment, which is never larger than one range partition, and a small
    per-segment summary carries counts, sums and the next row across
    partition borders. A group may span any number of partitions. All of it
    is built-in window and aggregate functions. Input should be narrow (keys
    and numbers); join payload back by key afterwards.
    """
    group = list(group)
    sums = list(sums)
    leads = list(leads)
    exprs = [F.col(g) for g in group] + _order_exprs(order)
    ranged = _range(df, exprs, num_partitions)
    local = stable(
        ranged.withColumn("_pid", F.spark_partition_id()).withColumn(
            "_lidx", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("bigint"), 33)
        )
    )
    seg_w = Window.partitionBy("_pid", *group).orderBy("_lidx")
    seg_run = seg_w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = local.select(
        "*",
        (F.row_number().over(seg_w) - 1).cast("bigint").alias("_gpos"),
        *[F.sum(s).over(seg_run).alias(f"_cum_{s}") for s in sums],
        *[F.lead(c).over(seg_w).alias(f"_lead_{c}") for c in leads],
    )

    agg = [F.count(F.lit(1)).alias("_seg_n")] + [F.sum(s).alias(f"_seg_{s}") for s in sums]
    agg += [F.min_by(F.col(c), F.col("_lidx")).alias(f"_first_{c}") for c in leads]
    segs = local.groupBy("_pid", *group).agg(*agg)
    by_group = Window.partitionBy(*group)
    before = by_group.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry_cols = [F.coalesce(F.sum("_seg_n").over(before), F.lit(0)).alias("_c_n")] + [
        F.coalesce(F.sum(f"_seg_{s}").over(before), F.lit(0)).alias(f"_c_{s}") for s in sums
    ]
    carry_cols += [F.lead(f"_first_{c}").over(by_group.orderBy("_pid")).alias(f"_nf_{c}") for c in leads]
    if totals:
        carry_cols += [F.sum("_seg_n").over(by_group).alias("group_rows")]
        carry_cols += [F.sum(f"_seg_{s}").over(by_group).alias(f"total_{s}") for s in sums]
    carries = segs.select("_pid", *[F.col(g).alias(f"_k_{g}") for g in group], *carry_cols)
    # null-safe on the group key: a NULL key is one group, as in groupBy
    cond = [scanned["_pid"] == carries["_pid"]] + [scanned[g].eqNullSafe(carries[f"_k_{g}"]) for g in group]
    out = scanned.join(carries, cond).drop(carries["_pid"]).drop(*[f"_k_{g}" for g in group])
    out = out.withColumn(pos_col, (F.col("_gpos") + F.col("_c_n")).cast("bigint"))
    for s in sums:
        out = out.withColumn(f"cum_{s}", F.col(f"_cum_{s}") + F.col(f"_c_{s}"))
    for c in leads:
        out = out.withColumn(f"next_{c}", F.coalesce(F.col(f"_lead_{c}"), F.col(f"_nf_{c}")))
    drop = ["_pid", "_lidx", "_gpos", "_c_n"] + [f"_cum_{s}" for s in sums] + [f"_c_{s}" for s in sums]
    drop += [f"_lead_{c}" for c in leads] + [f"_nf_{c}" for c in leads]
    return out.drop(*drop)
