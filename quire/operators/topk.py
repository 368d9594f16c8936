"""W6 without scoring every pair: exact top-k over clustered blocks.

Both sides are assigned to the nearest of a bounded set of pivots; the rows of
a pivot are split into blocks, and small neighbouring pivots share one. A block
knows a bound of the angle between its rows and its pivot, so the angle between
a query block and a candidate block is at least ``angle(pivots) - radius -
radius`` and no score of the cell can exceed its cosine. A few seed cells give
every query k scores; the least k-th score of a query block is what a cell has
to reach. Only cells whose bound reaches it are multiplied, so the result is
that of scoring everything, and vectors without clusters cost what scoring
everything costs.

The pivots come from a sample of at most ``SAMPLE_PER_PIVOT * pivots``
candidates; every row of both sides is indexed and searched. Block summaries
meet by pivot, never all against all; only tables of at most one row per pivot,
or per pair of pivots, pass the driver.

Defined results for odd input: zero and null vectors score 0 with everything
and form a block group that is never skipped; ties go to the smaller candidate
id; fewer than k candidates give all of them; an empty side gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.vectors import np_normalize, np_stack
from quire.operators.similarity import _no_rows, _type_of, rank_top_k
from quire.session import stable

SAMPLE_PER_PIVOT = 32
#: Pivot number of zero vectors, which have no direction.
NOWHERE = -1
#: Below every cosine.
NO_SCORE = -2.0
#: Bounds are compared with this much slack, far above rounding.
_SLACK = 1e-9


@dataclass
class TopK:
    """``rows``: query_id, candidate_id, score, rank. ``cells``: one row per
    pair of blocks (_qp, _qb, _cp, _cb) that was multiplied. ``n_cells``: how
    many pairs of blocks there are."""

    rows: DataFrame
    cells: DataFrame
    n_cells: int


def choose_pivots(candidates: DataFrame, candidate_id: str, vec: str, pivots: int, rounds: int = 4) -> np.ndarray:
    """Unit pivot vectors: spherical k-means on the candidates with the
    smallest id hashes (a bounded sample), at most ``pivots`` of them."""
    sample = candidates.orderBy(F.xxhash64(candidate_id), candidate_id).select(vec).limit(SAMPLE_PER_PIVOT * pivots).toPandas()
    unit = np_normalize(np_stack(sample[vec]))
    unit = unit[np.linalg.norm(unit, axis=1) > 0] if unit.size else unit
    unit = np.unique(unit, axis=0) if len(unit) else unit
    if not len(unit):
        return np.zeros((0, 0))
    # farthest-first start: the next pivot is the row least like all before it
    centre = [unit[0]]
    best = unit @ unit[0]
    while len(centre) < min(pivots, len(unit)):
        at = int(np.argmin(best))
        centre.append(unit[at])
        best = np.maximum(best, unit @ unit[at])
    centre = np.vstack(centre)
    for _ in range(rounds):
        near = np.argmax(unit @ centre.T, axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, near, unit)
        moved = np_normalize(sums)
        alive = np.linalg.norm(moved, axis=1) > 0
        centre = np.where(alive[:, None], moved, centre)
    return centre


def _indexed(side: DataFrame, row_id: str, vec: str, centre: np.ndarray) -> DataFrame:
    """(id, vec, _p, _angle): the nearest pivot of every row and the angle to it."""
    schema = T.StructType(
        [
            T.StructField("_id", _type_of(side, row_id)),
            T.StructField("_v", T.ArrayType(T.DoubleType())),
            T.StructField("_p", T.IntegerType()),
            T.StructField("_angle", T.DoubleType()),
        ]
    )

    def run(batches):
        for pdf in batches:
            unit = np_normalize(np_stack(pdf["_v"]))
            pivot = np.full(len(pdf), NOWHERE, np.int32)
            angle = np.full(len(pdf), np.pi)
            if unit.size and len(centre):
                live = np.linalg.norm(unit, axis=1) > 0
                cos = unit[live] @ centre.T
                pivot[live] = np.argmax(cos, axis=1)
                angle[live] = np.arccos(np.clip(cos.max(axis=1), -1.0, 1.0))
            yield pd.DataFrame({"_id": pdf["_id"], "_v": list(unit) if unit.size else [None] * len(pdf), "_p": pivot, "_angle": angle})

    return side.select(F.col(row_id).alias("_id"), F.col(vec).cast("array<double>").alias("_v")).mapInPandas(run, schema)


def _grouped(n: dict[int, int], turn, block_rows: int) -> dict[int, int]:
    """Head pivot of every pivot: pivots with few rows share a block with the
    pivots next to them, up to about ``block_rows`` rows."""
    left, heads = sorted(p for p in n if p != NOWHERE), {p: p for p in n}
    while left:
        head = left[0]
        total = n[head]
        left.remove(head)
        for p in sorted(left, key=lambda x: (turn(head, x), x)):
            if total + n[p] > block_rows:
                break
            total += n[p]
            heads[p] = head
            left.remove(p)
    return heads


def _blocked(rows: DataFrame, turn, block_rows: int) -> tuple[DataFrame, list[dict]]:
    """Rows with their head pivot ``_p``, the block ``_b`` there and ``_angle``,
    now a bound of the angle to the head; and (_p, blocks, radius) per head."""
    per = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.max("_angle").alias("radius")).collect()  # a row per pivot
    if not per:
        return rows.withColumn("_b", F.lit(0)), []
    heads = _grouped({r["_p"]: r["n"] for r in per}, turn, block_rows)
    out: dict[int, dict] = {}
    for r in per:
        h = out.setdefault(heads[r["_p"]], {"_p": heads[r["_p"]], "n": 0, "radius": 0.0})
        h["n"] += r["n"]
        h["radius"] = max(h["radius"], r["radius"] + turn(r["_p"], h["_p"]))
    for h in out.values():
        h["blocks"] = max(1, math.ceil(h["n"] / block_rows))

    def told(pairs):
        return F.create_map(*[F.lit(x) for pair in pairs for x in pair])[F.col("_p")]

    placed = rows.select(
        "_id",
        "_v",
        told((p, h) for p, h in heads.items()).alias("_p"),
        F.pmod(F.xxhash64("_id"), told((p, out[h]["blocks"]) for p, h in heads.items())).cast("int").alias("_b"),
        (F.col("_angle") + told((p, turn(p, h)) for p, h in heads.items())).alias("_angle"),
    )
    return placed, list(out.values())


def _cut(k: int, row, cid, score):
    """The k best entries of every row, ties to the smaller id, by row."""
    order = np.lexsort((cid, -score, row))
    row, cid, score = row[order], cid[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], cid[keep], score[keep]


def _best(a: np.ndarray, b: np.ndarray, cids: np.ndarray, k: int, floor: np.ndarray, tile: int = 1024):
    """(row, candidate id, score) of the k highest scores of every row that
    reach its ``floor``, a tile of candidates at a time. Only scores at or
    above the k-th so far are sorted."""
    row, cid, score = np.zeros(0, np.int64), cids[:0], np.zeros(0)
    for lo in range(0, len(b), tile):
        part = b[lo : lo + tile]
        s = a @ part.T if a.shape[1] == b.shape[1] else np.zeros((len(a), len(part)))
        reach = floor if k >= s.shape[1] else np.maximum(floor, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
        r, c = np.nonzero(s >= reach[:, None])
        row, cid, score = _cut(k, np.r_[row, r], np.r_[cid, cids[lo : lo + tile][c]], np.r_[score, s[r, c]])
        full = np.flatnonzero(np.bincount(row, minlength=len(a)) == k)
        floor = floor.copy()
        floor[full] = np.maximum(floor[full], score[np.searchsorted(row, full, side="right") - 1])
    return row, cid, score


def _score(q: DataFrame, c: DataFrame, cells: DataFrame, k: int, names: tuple[str, str], types) -> DataFrame:
    """The k best of every query in each of ``cells`` (_qp, _qb, _cp, _cb), as
    far as they reach the query's ``_floor``."""
    key = ["_qp", "_qb", "_cp", "_cb"]
    left = q.select(F.col("_p").alias("_qp"), F.col("_b").alias("_qb"), "_id", "_v", "_floor").join(cells, ["_qp", "_qb"])
    right = c.select(F.col("_p").alias("_cp"), F.col("_b").alias("_cb"), "_id", "_v").join(cells, ["_cp", "_cb"])
    schema = T.StructType([T.StructField(names[0], types[0]), T.StructField(names[1], types[1]), T.StructField("score", T.DoubleType())])
    columns = [*names, "score"]

    def cell(qp: pd.DataFrame, cp: pd.DataFrame) -> pd.DataFrame:
        if not len(qp) or not len(cp):
            return _no_rows(columns)
        floor = qp["_floor"].to_numpy(dtype=np.float64) - _SLACK
        row, cid, score = _best(np_stack(qp["_v"]), np_stack(cp["_v"]), cp["_id"].to_numpy(), k, floor)
        return pd.DataFrame({columns[0]: qp["_id"].to_numpy()[row], columns[1]: cid, "score": score})

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(cell, schema)


def nearest_candidates(
    queries: DataFrame,
    candidates: DataFrame,
    k: int,
    query_id: str = "query_id",
    candidate_id: str = "candidate_id",
    vec: str = "vec",
    pivots: int = 128,
    block_rows: int = 8192,
    query_rows: int = 4096,
) -> TopK:
    """The k candidates of highest cosine for every query, exactly. ``pivots``
    is the most there may be; a pivot for every ``block_rows`` candidates is
    enough, since a cell costs one Python call. A candidate is copied once per
    query block of about ``query_rows`` rows that it may matter to."""
    spark = queries.sparkSession
    pivots = max(1, min(pivots, math.ceil(candidates.count() / block_rows)))
    names, types = (query_id, candidate_id), (_type_of(queries, query_id), _type_of(candidates, candidate_id))
    centre = choose_pivots(candidates, candidate_id, vec, pivots)
    # angle between pivots; a group of zero vectors is next to everything
    turns = np.arccos(np.clip(centre @ centre.T, -1.0, 1.0)) if len(centre) else np.zeros((0, 0))
    np.fill_diagonal(turns, 0.0)

    def between(a: int, b: int) -> float:
        return 0.0 if NOWHERE in (a, b) else float(turns[a, b])

    q, q_per = _blocked(stable(_indexed(queries, query_id, vec, centre)), between, query_rows)
    c, c_per = _blocked(stable(_indexed(candidates, candidate_id, vec, centre)), between, block_rows)
    n_cells = sum(r["blocks"] for r in q_per) * sum(r["blocks"] for r in c_per)
    cell_type = "_qp int, _qb int, _cp int, _cb int"
    if not n_cells:
        empty = spark.createDataFrame([], T.StructType([T.StructField(n, t) for n, t in zip(names, types)] + [T.StructField("score", T.DoubleType())]))
        return TopK(rank_top_k(empty, k, *names), spark.createDataFrame([], cell_type), 0)

    # seeds: for a query pivot, block 0 of the nearest candidate pivots, until they hold k rows
    held = {r["_p"]: r["n"] for r in c.where("_b = 0").groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}
    seeds = []
    for r in q_per:
        total = 0
        for p in sorted(held, key=lambda x: (between(r["_p"], x), x)):
            if total >= k:
                break
            total += held[p]
            seeds.append((r["_p"], p))
    q_blocks = q.groupBy("_p", "_b").agg(F.max("_angle").alias("_radius"), F.count(F.lit(1)).alias("_n"))
    q_blocks = stable(q_blocks.withColumnsRenamed({"_p": "_qp", "_b": "_qb"}))
    seed_cells = q_blocks.select("_qp", "_qb").join(spark.createDataFrame(seeds, "_qp int, _cp int"), "_qp").withColumn("_cb", F.lit(0))
    seed_cells = seed_cells.select("_qp", "_qb", "_cp", "_cb")
    q = q.withColumn("_floor", F.lit(NO_SCORE))
    first = stable(rank_top_k(_score(q, c, seed_cells, k, names, types), k, *names).drop("rank"))

    # what a cell must reach: the least k-th score in the query block
    kth = first.groupBy(F.col(query_id).alias("_id")).agg(F.count(F.lit(1)).alias("_found"), F.min("score").alias("_kth"))
    floor = F.when(F.col("_found") >= k, F.col("_kth")).otherwise(F.lit(NO_SCORE))
    q = stable(q.drop("_floor").join(kth, "_id", "left").withColumn("_floor", floor).drop("_found", "_kth"))
    need = q.groupBy(F.col("_p").alias("_qp"), F.col("_b").alias("_qb")).agg(F.min("_floor").alias("_need"))
    gaps = spark.createDataFrame(
        [(a["_p"], b["_p"], between(a["_p"], b["_p"]), b["radius"]) for a in q_per for b in c_per],
        "_qp int, _cp int, _turn double, _widest double",
    )
    # blocks of a pivot come in only if its widest block could still reach the need
    c_blocks = c.groupBy("_p", "_b").agg(F.max("_angle").alias("_wide")).withColumnsRenamed({"_p": "_cp", "_b": "_cb"})

    def reaches(radius: str):
        gap = F.greatest(F.lit(0.0), F.col("_turn") - F.col("_radius") - F.col(radius))
        return F.cos(F.least(gap, F.lit(math.pi))) >= F.col("_need") - F.lit(_SLACK)

    open_pivots = q_blocks.join(need, ["_qp", "_qb"]).join(gaps, "_qp").where(reaches("_widest"))
    kept = open_pivots.join(c_blocks, "_cp").where(reaches("_wide")).select("_qp", "_qb", "_cp", "_cb")
    rest = stable(kept.join(seed_cells, ["_qp", "_qb", "_cp", "_cb"], "left_anti"))
    more = _score(q, c, rest, k, names, types)
    rows = rank_top_k(first.unionByName(more), k, *names)
    return TopK(rows, seed_cells.unionByName(rest), n_cells)
