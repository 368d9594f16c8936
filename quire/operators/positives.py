"""Attribution evaluation from vectors, without query x candidate rows.

EER and AP of a query depend on its positive scores, on how many negatives lie
between neighbouring positive scores, and near one crossing on the negatives
themselves. A block of queries is held by one cell while the candidates pass by
three times (:mod:`quire.operators.streams`):

1. positives: the cell keeps the scores of its queries' positive pairs;
2. counts: of every batch of candidates, it counts the negatives per interval
   between those scores (and per tie with one of them);
3. refinement: ``fnr - fpr`` falls along the curve, so the best point lies
   next to its change of sign. Positive thresholds and the last negative
   before each of them are known from the counts. Only if the sign changes
   strictly inside an interval of three or more negatives may a better point
   hide there (one where the number of tied negatives changes). Only those
   queries send the negatives of that one interval.

What is shuffled is three copies of the candidates per block of queries; scores
and counts never leave their cell. There is a block per core. Where a cell would
keep more than ``block_rows`` queries or ``POSITIVES`` positive scores, the
queries take several rounds of a block per core, each with a share of them; a
round's shuffle files leave the disk when it ends, so the disk never holds more
than three copies of the candidates per core. The curve and its rules are those of
:mod:`quire.operators.metrics`. Scores are compared to ``DECIMALS`` places, so
equal vectors tie in whatever batch they come. A null label equals no label.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.vectors import np_normalize
from quire.operators.indexing import grouped_running_sums
from quire.operators.streams import HELD_ROWS, dealt_to_all, matching, n_cells, pass_by, tiles, vectors, whole
from quire.session import passing_tables, scratch_path, stable

DECIMALS = 12
#: Positive scores that a cell keeps at most (8 bytes each, and 16 of counts per run).
POSITIVES = 1 << 24
#: Scores that are made and counted at once: few enough for a core's cache.
SCORES = 1 << 18


def half_up(x: np.ndarray, decimals: int) -> np.ndarray:
    """Round half away from zero, as SQL does."""
    scale = 10.0**decimals
    out = np.abs(np.atleast_1d(x))
    out *= scale
    out += 0.5
    np.floor(out, out=out)
    out /= scale
    np.copysign(out, x, out=out)
    out += 0.0  # no negative zero
    return out


class HeldQueries:
    """The queries of a cell; rows of one id are judged as one query."""

    def __init__(self, rows, decimals: Sequence[int | None]):
        self.unit = np_normalize(vectors(rows["v"]))
        self.labels = pc.drop_null(pc.unique(rows["label"]))
        self.label = self._numbered(rows["label"], -2)
        self.of, self.ids = pd.factorize(np.array(rows["q"].to_pylist(), dtype=object), use_na_sentinel=False)
        self.decimals = decimals
        self.pos = [[] for _ in self.ids]

    def _numbered(self, labels, none: int) -> np.ndarray:
        """Places among the held labels; ``none`` for nulls and other labels."""
        return pc.fill_null(pc.index_in(labels, value_set=self.labels), none).to_numpy(zero_copy_only=False)

    def scored(self, batch):
        """(query, its scores, which of them are positive) for a batch; the
        scores as they come, not yet cut to ``DECIMALS``."""
        unit, label = np_normalize(vectors(batch["v"])), self._numbered(batch["label"], -1)
        for rows in tiles(len(self.unit), len(unit), SCORES):
            scores = matching(self.unit[rows], unit)
            same = self.label[rows][:, None] == label[None, :]
            yield from zip(self.of[rows], scores, same)

    def rounded(self, scores: np.ndarray, run: int) -> np.ndarray:
        return scores if self.decimals[run] is None else half_up(scores, self.decimals[run])

    def add_positives(self, batch) -> None:
        """Scores of the pairs of equal labels; no others are computed."""
        unit, label = np_normalize(vectors(batch["v"])), self._numbered(batch["label"], -1)
        order = np.argsort(label, kind="stable")
        for found in np.intersect1d(label, self.label):
            theirs = unit[order[slice(*np.searchsorted(label[order], [found, found + 1]))]]
            mine = np.flatnonzero(self.label == found)
            for rows in tiles(len(mine), len(theirs), SCORES):
                scores = half_up(matching(self.unit[mine[rows]], theirs), DECIMALS)
                for g, x in zip(self.of[mine[rows]], scores):
                    self.pos[g].append(x)

    def close_positives(self) -> None:
        """Per query and run the thresholds, and a count of negatives for each
        place: below the first, tied with it, above it, and so on."""
        self.pos = [np.sort(np.concatenate(p)) if p else np.zeros(0) for p in self.pos]
        self.t = [[np.unique(self.rounded(p, r)) for r in range(len(self.decimals))] for p in self.pos]
        self.places = [[np.zeros(2 * len(t) + 1, np.int64) for t in of_runs] for of_runs in self.t]

    def add_negatives(self, batch) -> None:
        for g, scores, same in self.scored(batch):
            neg = half_up(scores[~same], DECIMALS)
            neg.sort()
            for r, t in enumerate(self.t[g]):
                x = self.rounded(neg, r)  # rounding keeps the order
                # the search goes by the batch, however many thresholds there are
                above = np.searchsorted(t, x, "right")
                place = 2 * above - (t[above - 1] == x) if len(t) else above
                first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]][: len(place)])
                self.places[g][r][place[first]] += np.diff(np.r_[first, len(place)])

    def known(self) -> list[list[tuple]]:
        """:func:`known_points` per query and run."""
        return [[self._known(g, r) for r in range(len(self.decimals))] for g in range(len(self.ids))]

    def _known(self, g: int, r: int) -> tuple:
        n = self.places[g][r]
        return known_points(self.rounded(self.pos[g], r), np.arange(len(n)), n)

    def between(self, batch, curve: list[list[tuple]]) -> list[tuple]:
        """(query, run, score, negatives) strictly inside open intervals."""
        out = []
        for g, scores, same in self.scored(batch):
            for r, found in enumerate(curve[g]):
                if found[_LOW] is not None:
                    low, high = found[_LOW : _LOW + 2]
                    off = 10.0 ** -min(DECIMALS, DECIMALS if self.decimals[r] is None else self.decimals[r])  # rounding moves by less
                    near = scores[(scores > low - off) & (scores < high + off) & ~same]
                    neg = self.rounded(half_up(near, DECIMALS), r)
                    value, n = np.unique(neg[(neg > low) & (neg < high)], return_counts=True)
                    out += [(self.ids[g], r, float(v), int(m)) for v, m in zip(value, n)]
        return out


_KNOWN = "n_pos long, n_neg long, ap double, gap double, fpr double, fnr double, before boolean, low double, high double, tps long, fps long"
_NAMES = [x.split()[0] for x in _KNOWN.split(", ")]
_LOW = _NAMES.index("low")


def known_points(pos: np.ndarray, place: np.ndarray, n: np.ndarray) -> tuple:
    """What positives and interval counts tell of a query: totals, AP, the
    best known point of the curve and, if a better one may lie inside an
    interval, that interval, the counts above it, and whether the best known
    point lies above it."""
    t, tp = np.unique(pos, return_counts=True)
    k = len(t)
    counts = np.zeros(2 * k + 1, np.int64)
    counts[place] = n
    tp, tie, gap = tp[::-1], counts[1::2][::-1], counts[0::2][::-1]  # best threshold first; gap[i] lies above it
    n_pos, n_neg = int(tp.sum()), int(counts.sum())
    tps, fps = np.cumsum(tp), np.cumsum(gap[:k] + tie)
    ap = float(np.sum(tp / n_pos * (tps / (tps + fps)))) if n_pos else 0.0
    if not n_pos or not n_neg:
        return n_pos, n_neg, ap, *(None,) * 8
    last = np.arange(k) == k - 1
    kept = (gap[1:] > 0) | last | ((np.arange(k) == 0) & (gap[0] == 0))
    kept[:-1] |= (tp[1:] != tp[:-1]) | (tie[1:] != tie[:-1])
    # the curve's known points in order: origin, per threshold the last
    # negative above it and the threshold itself, the end
    x = np.concatenate([[0], np.column_stack([fps - tie, fps]).ravel(), [n_neg]])
    y = np.concatenate([[0], np.column_stack([tps - tp, tps]).ravel(), [n_pos]])
    there = np.concatenate([[True], np.column_stack([gap[:k] > 0, kept]).ravel(), [gap[k] > 0]])
    fpr, fnr = x / n_neg, 1.0 - y / n_pos
    off = np.where(there, np.abs(fnr - fpr), np.inf)
    best = int(np.argmin(off))
    inside = np.flatnonzero((gap[1:k] >= 3) & ((fnr - fpr)[2 : 2 * k : 2] > 0) & ((fnr - fpr)[3 : 2 * k + 1 : 2] < 0)) + 1
    found = (n_pos, n_neg, ap, float(off[best]), float(fpr[best]), float(fnr[best]))
    if not len(inside):
        return *found, *(None,) * 5
    i = int(inside[0])
    return *found, best <= 2 * i, float(t[::-1][i]), float(t[::-1][i - 1]), int(tps[i - 1]), int(fps[i - 1])


def evaluate_vectors(
    queries: DataFrame,
    candidates: DataFrame,
    query_id: str = "query_id",
    candidate_id: str = "candidate_id",
    vec: str = "vec",
    label: str = "label",
    runs: Sequence[tuple[str, int | None]] = (("exact", None),),
    block_rows: int = HELD_ROWS,
) -> DataFrame:
    """``(run_id, query_id, n_pos, n_neg, eer, ap)`` of cosine scores, where a
    pair is positive if its labels are equal. ``runs`` names the runs and the
    decimals that their scores are rounded to (None: not rounded)."""
    key, decimals = ["q", "run"], [d for _, d in runs]
    q = queries.select(F.col(query_id).alias("q"), F.col(vec).alias("v"), F.col(label).alias("label"))
    c = candidates.select(F.col(vec).alias("v"), F.col(label).alias("label"))
    most = c.where("label IS NOT NULL").groupBy("label").count().agg(F.max("count")).first()[0] or 1  # one number
    rows = q.agg(F.count(F.lit(1))).first()[0]  # one number
    spark = q.sparkSession
    cores = spark.sparkContext.defaultParallelism
    n = n_cells(rows, cores, max(1, min(block_rows, POSITIVES // most)))
    rounds = -(-n // cores)
    n = min(n, cores)
    names = [*key, *_NAMES, "score", "ties"]

    def cell(_, phases):
        held = curve = None
        for phase, batches in phases:
            if phase == 0:
                held = HeldQueries(whole(batches), decimals)
            elif held is None:
                break
            elif phase == 1:
                for batch in batches:
                    held.add_positives(batch)
                held.close_positives()
            elif phase == 2:
                for batch in batches:
                    held.add_negatives(batch)
            else:
                curve = held.known()
                for batch in batches:
                    inside = held.between(batch, curve)
                    yield pd.DataFrame([(x, r, *(None,) * len(_NAMES), v, m) for x, r, v, m in inside], columns=names, dtype=object)
        if held is not None:
            if curve is None:  # no candidates
                held.close_positives()
                curve = held.known()
            yield pd.DataFrame([(x, r, *found, None, None) for g in held.of for x, of_runs in [(held.ids[g], curve[g])] for r, found in enumerate(of_runs)], columns=names, dtype=object)

    held = q.withColumn("cell", F.pmod(F.xxhash64("q"), F.lit(n)).cast("int"))
    schema = f"q {q.schema['q'].dataType.simpleString()}, run int, {_KNOWN}, score double, ties long"
    evaluated = lambda some: pass_by(some, dealt_to_all(c, "cell", n), ["cell"], n, cell, schema, phases=3)
    if rounds == 1:
        out = stable(evaluated(held))
    else:
        # not the hash that deals queries to cells
        share = F.pmod(F.xxhash64(F.lit("round"), "q"), F.lit(rounds))
        base = scratch_path(spark, "evaluated")
        for r in range(rounds):
            with passing_tables(spark):
                evaluated(held.where(share == r)).write.parquet(f"{base}/round={r}")
        out = spark.read.parquet(base).drop("round")
    curve = out.where("score IS NULL").drop("score", "ties")
    open_ = curve.where("low IS NOT NULL")
    best = _inside(out.where("score IS NOT NULL"), open_) if open_.agg(F.count(F.lit(1))).first()[0] else None  # one number
    if best is not None:
        curve = curve.join(best, key, "left")
        closer = F.col("in.gap").isNotNull() & ((F.col("in.gap") < F.col("gap")) | ((F.col("in.gap") == F.col("gap")) & ~F.col("before")))
        curve = curve.select(*[c for c in curve.columns if c not in ("gap", "fpr", "fnr", "in")], *[F.when(closer, F.col(f"in.{c}")).otherwise(F.col(c)).alias(c) for c in ("gap", "fpr", "fnr")])
    eer = F.when(F.col("gap") < 1.0, (F.col("fpr") + F.col("fnr")) / 2.0).when(F.col("gap").isNotNull(), F.lit(0.5))
    run_name = F.get(F.array(*[F.lit(x) for x, _ in runs]), F.col("run"))
    return curve.select(run_name.alias("run_id"), F.col("q").alias(query_id), "n_pos", "n_neg", eer.alias("eer"), "ap")


def _inside(inside: DataFrame, open_: DataFrame) -> DataFrame | None:
    """Per open query and run the best point strictly inside its interval that
    the curve keeps: a negative threshold whose number of tied negatives
    differs from that of the next one. None if no interval has such a point."""
    key = ["q", "run"]
    neg = stable(inside.groupBy(*key, "score").agg(F.sum("ties").alias("ties")))
    mixed = neg.groupBy(*key).agg(F.min("ties").alias("a"), F.max("ties").alias("b")).where("a <> b").select(*key)
    if not mixed.agg(F.count(F.lit(1))).first()[0]:  # one number
        return None
    run = grouped_running_sums(neg.join(mixed, key, "left_semi"), key, [F.col("score").desc()], ["ties"], leads=["ties"])
    run = run.where("next_ties IS NOT NULL AND next_ties <> ties").join(open_.select(*key, "tps", "fps", "n_pos", "n_neg"), key)
    fpr, fnr = (F.col("fps") + F.col("cum_ties")) / F.col("n_neg"), F.lit(1.0) - F.col("tps") / F.col("n_pos")
    point = F.struct(F.abs(fnr - fpr).alias("gap"), (-F.col("score")).alias("order"), fpr.alias("fpr"), fnr.alias("fnr"))
    return run.groupBy(*key).agg(F.min(point).alias("in"))
