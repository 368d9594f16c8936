"""Held-out contrastive losses as batch aggregates.

Rows are grouped by ``batch_id`` (from R8, so a batch holds at most
``batch_size`` rows); each batch is one bounded group whose similarity
matrix is a numpy product. The result is one row per batch:
``(batch_id, n, loss)``; average it for an epoch value.

For batches larger than one group, the ``tiled_*`` forms cut a batch into
blocks. The ranking loss cuts the similarity matrix into tiles; a tile gives
every row its maximum and its sum of exponentials below that maximum (F5),
which merge. The multi-positive loss holds a block per cell while the rows of
the batch pass by (:mod:`quire.operators.streams`), and merges as they pass.
No task holds more than a block and a tile. The number of blocks follows from
the largest batch; batches of one feed are equally large (R8).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.vectors import np_normalize, np_stack
from quire.operators.streams import HELD_ROWS, dealt_to_all, matching, n_cells, pass_by, tiles, vectors, whole
from quire.session import stable


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    """row-max-stabilised log-sum-exp."""
    m = np.max(x, axis=axis, keepdims=True)
    return (m + np.log(np.sum(np.exp(x - m), axis=axis, keepdims=True))).squeeze(axis)


_OUT = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("loss", T.DoubleType()),
    ]
)


def symmetric_ranking_loss(
    pairs: DataFrame,
    batch: str = "batch_id",
    anchor: str = "anchor_vec",
    positive: str = "positive_vec",
    scale: float = 20.0,
    similarity: str = "cosine",
    negatives: tuple[str, ...] = (),
) -> DataFrame:
    """``s_ij = scale * sim(anchor_i, positive_j)`` inside a batch;
    forward ``lse_j s_ij - s_ii``, backward ``lse_i s_ij - s_jj``; the loss is
    half the sum of their means. ``similarity`` is ``cosine`` or ``dot``.

    ``negatives`` names extra vector columns (hard negatives). As in the
    reference, they widen the forward term only: each anchor is scored
    against every positive and every negative of the batch; the backward
    term uses the positives alone."""

    def sim(x: np.ndarray) -> np.ndarray:
        return np_normalize(x) if similarity == "cosine" else x

    def per_batch(pdf: pd.DataFrame) -> pd.DataFrame:
        a = sim(np_stack(pdf[anchor]))
        p = sim(np_stack(pdf[positive]))
        s = scale * (a @ p.T)
        d = np.diag(s)
        wide = s
        for col in negatives:
            wide = np.hstack([wide, scale * (a @ sim(np_stack(pdf[col])).T)])
        fwd = np.mean(_lse(wide, 1) - d)
        bwd = np.mean(_lse(s, 0) - d)
        return pd.DataFrame({"batch_id": [int(pdf[batch].iloc[0])], "n": [len(pdf)], "loss": [(fwd + bwd) / 2.0]})

    return pairs.select(batch, anchor, positive, *negatives).groupBy(batch).applyInPandas(per_batch, _OUT)


def multi_positive_loss(
    rows: DataFrame,
    batch: str = "batch_id",
    label: str = "label",
    vec: str = "vec",
    temperature: float = 0.1,
) -> DataFrame:
    """Normalised vectors, ``s_ij = dot / temperature``, self excluded,
    ``p_ij = [same label] / max(1, #positives of i)``,
    ``loss_i = -sum_j p_ij log_softmax_j(s_ij)``; mean over every row of the
    batch (a row without positives adds 0). The positive mask is built per
    batch from that batch's labels."""

    def per_batch(pdf: pd.DataFrame) -> pd.DataFrame:
        unit = np_normalize(np_stack(pdf[vec]))
        labels = pdf[label].to_numpy()
        per_row = np.zeros(len(pdf))
        if len(pdf) > 1:
            for i in range(len(pdf)):
                others = np.delete(unit, i, 0) @ unit[i] / temperature
                alike = np.delete(labels, i) == labels[i]
                if alike.any():  # lse_i - mean of s_ij over the positives j
                    per_row[i] = _lse(others[None, :], 1)[0] - others[alike].mean()
        return pd.DataFrame({"batch_id": [int(pdf[batch].iloc[0])], "n": [len(pdf)], "loss": [float(per_row.mean())]})

    return rows.select(batch, label, vec).groupBy(batch).applyInPandas(per_batch, _OUT)


# ---- batches of any size ---------------------------------------------------


def _merged_lse(parts: str = "parts") -> tuple[Column, Column]:
    """Log-sum-exp of tiles given as an array of (m, s), maximum and sum of
    exponentials below it, and the overall maximum, which is to stand in the
    column ``top``."""
    top = F.array_max(F.transform(parts, lambda x: x["m"]))
    total = F.aggregate(F.transform(parts, lambda x: x["s"] * F.exp(x["m"] - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.col("top").isNotNull(), F.col("top") + F.log(total)), top


def _products(left, right, normalise: bool = True) -> np.ndarray:
    """Similarity of every left to every right vector; 0 where a side holds
    null vectors only."""
    a, b = np_stack(left), np_stack(right)
    if a.shape[1] != b.shape[1] and 0 in (a.shape[1], b.shape[1]):
        return np.zeros((len(a), len(b)))
    return np_normalize(a) @ np_normalize(b).T if normalise else a @ b.T


def _in_blocks(rows: DataFrame, batch: str, block_rows: int, per_core: bool = False) -> tuple[DataFrame, int]:
    """Rows that have a batch, with a row number ``_r`` and a block ``_b``,
    written once so that both stay, and the number of blocks of a batch (with
    ``per_core``, so many that all batches together have one per core)."""
    placed = stable(rows.where(F.col(batch).isNotNull()).withColumn("_r", F.monotonically_increasing_id()))
    largest, batches = placed.groupBy(batch).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()  # two numbers
    blocks = max(1, -(-int(largest) // int(block_rows)))
    if per_core:
        cores = rows.sparkSession.sparkContext.defaultParallelism
        blocks = n_cells(int(largest), -(-cores // max(1, batches)), block_rows)
    return placed.withColumn("_b", F.pmod(F.xxhash64("_r"), F.lit(blocks)).cast("int")), blocks


def _tiles(left: DataFrame, right: DataFrame, batch: str, blocks: int, kernel, schema: str) -> DataFrame:
    """``kernel(left block, right block)`` for every pair of blocks of a batch."""
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    key = [batch, "_i", "_j"]
    left = left.withColumnRenamed("_b", "_i").withColumn("_j", others)
    right = right.withColumnRenamed("_b", "_j").withColumn("_i", others)
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(kernel, schema)


def _partial(s: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    m = s.max(axis=axis, keepdims=True)
    return m.squeeze(axis), np.exp(s - m).sum(axis=axis)


def tiled_ranking_loss(
    pairs: DataFrame,
    batch: str = "batch_id",
    anchor: str = "anchor_vec",
    positive: str = "positive_vec",
    scale: float = 20.0,
    similarity: str = "cosine",
    block_rows: int = 2048,
) -> DataFrame:
    """:func:`symmetric_ranking_loss` for batches of any size."""
    unit = similarity == "cosine"
    rows, blocks = _in_blocks(pairs.select(F.col(batch).alias("_batch"), F.col(anchor).alias("_a"), F.col(positive).alias("_p")), "_batch", block_rows)
    names = ["_batch", "_r", "side", "m", "s", "own"]

    def tile(ap: pd.DataFrame, pp: pd.DataFrame) -> pd.DataFrame:
        if not len(ap) or not len(pp):
            return pd.DataFrame({n: pd.Series([], dtype=object) for n in names})
        s = scale * _products(ap["_a"], pp["_p"], unit)
        ar, pr = ap["_r"].to_numpy(), pp["_r"].to_numpy()
        own = np.full(len(ap) + len(pp), np.nan)  # s_ii, known to the tile that holds both halves
        if ap["_i"].iloc[0] == ap["_j"].iloc[0]:
            at = np.argsort(pr)
            own[: len(ap)] = s[np.arange(len(ap)), at[np.searchsorted(pr[at], ar)]]
            ra = np.argsort(ar)
            own[len(ap) :] = s[ra[np.searchsorted(ar[ra], pr)], np.arange(len(pp))]
        (fm, fs), (bm, bs) = _partial(s, 1), _partial(s, 0)
        return pd.DataFrame(
            {
                "_batch": np.repeat(ap["_batch"].to_numpy()[:1], len(own)),
                "_r": np.r_[ar, pr],
                "side": np.r_[np.zeros(len(ap), np.int32), np.ones(len(pp), np.int32)],
                "m": np.r_[fm, bm],
                "s": np.r_[fs, bs],
                "own": own,
            }
        )

    kind = pairs.schema[batch].dataType.simpleString()
    parts = _tiles(
        rows.select("_batch", "_r", "_b", "_a"), rows.select("_batch", "_r", "_b", "_p"), "_batch", blocks, tile,
        f"_batch {kind}, _r long, side int, m double, s double, own double",
    )
    lse, top = _merged_lse()
    per_row = (
        parts.groupBy("_batch", "_r", "side")
        .agg(F.collect_list(F.struct("m", "s")).alias("parts"), F.max(F.when(~F.isnan("own"), F.col("own"))).alias("own"))
        .withColumn("top", top)
        .withColumn("gap", lse - F.col("own"))
    )
    mean = lambda side: F.avg(F.when(F.col("side") == side, F.col("gap")))
    return per_row.groupBy(F.col("_batch").cast("long").alias("batch_id")).agg(
        F.sum(1 - F.col("side")).cast("long").alias("n"), ((mean(0) + mean(1)) / 2).alias("loss")
    )


class _HeldRows:
    """Rows of a block with their running maximum, sum of exponentials below
    it, and the sum and number of their positives' similarities."""

    def __init__(self, rows, temperature: float):
        self.unit, self.r, self.label = np_normalize(vectors(rows["_v"])), rows["_r"].to_numpy(), rows["_l"].to_pandas().to_numpy()
        self.temperature, n = temperature, len(self.r)
        self.m, self.s, self.alike, self.n_alike = np.full(n, -np.inf), np.zeros(n), np.zeros(n), np.zeros(n, np.int64)

    def add(self, rows) -> None:
        unit, r, label = np_normalize(vectors(rows["_v"])), rows["_r"].to_numpy(), rows["_l"].to_pandas().to_numpy()
        for some in tiles(len(self.r), len(r)):
            s = matching(self.unit[some], unit) / self.temperature
            alike = self.label[some][:, None] == label[None, :]
            at, here = np.nonzero(np.isin(self.r[some], r))[0], np.argsort(r)
            mine = (at, here[np.searchsorted(r[here], self.r[some][at])])  # each row beside itself
            alike[mine] = False
            self.alike[some] += np.where(alike, s, 0.0).sum(axis=1)
            self.n_alike[some] += alike.sum(axis=1)
            s[mine] = -np.inf
            m = np.maximum(self.m[some], s.max(axis=1))
            top = np.where(np.isneginf(m), 0.0, m)  # nothing but the row itself so far
            self.s[some] = self.s[some] * np.exp(self.m[some] - top) + np.exp(s - top[:, None]).sum(axis=1)
            self.m[some] = m

    def losses(self) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.n_alike > 0, self.m + np.log(self.s) - self.alike / self.n_alike, 0.0)


def tiled_multi_positive_loss(
    rows: DataFrame,
    batch: str = "batch_id",
    label: str = "label",
    vec: str = "vec",
    temperature: float = 0.1,
    block_rows: int = HELD_ROWS,
) -> DataFrame:
    """:func:`multi_positive_loss` for batches of any size. The rows are copied
    once per block, and there is a block per core until a block would hold
    more than ``block_rows``."""
    rows, blocks = _in_blocks(rows.select(F.col(batch).alias("_batch"), F.col(label).alias("_l"), F.col(vec).alias("_v")), "_batch", block_rows, per_core=True)

    def cell(key, phases):
        held = None
        for phase, batches in phases:
            if phase == 0:
                held = _HeldRows(whole(batches), temperature)
            for b in batches if phase and held is not None else ():
                held.add(b)
        if held is not None:
            yield pd.DataFrame({"_batch": [key[0]] * len(held.r), "loss": held.losses()})

    kind = rows.schema["_batch"].dataType.simpleString()
    n = max(blocks, rows.sparkSession.sparkContext.defaultParallelism)
    per_row = pass_by(rows, dealt_to_all(rows.drop("_b"), "_b", blocks), ["_batch", "_b"], n, cell, f"_batch {kind}, loss double")
    return per_row.groupBy(F.col("_batch").cast("long").alias("batch_id")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("loss").alias("loss")
    )
