"""Evaluation without query x candidate rows, against the curve over all
scores and against numpy."""

import numpy as np
import pytest

from quire.operators import positives
from quire.plans import scoring
from tests import metrics_ref


def _frames(spark, rng, nq, nc, labels, vectors):
    row = lambda i: (int(i), [float(x) for x in vectors[rng.integers(len(vectors))]], None if (x := int(rng.integers(labels + 1))) == labels else x)
    q, c = ([row(i) for i in range(n)] for n in (nq, nc))
    return (spark.createDataFrame(q, "query_id long, vec array<double>, label int"), spark.createDataFrame(c, "candidate_id long, vec array<double>, label int"), q, c)


def _reference(q, c, decimals):
    out = {}
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    s = positives.half_up(unit(np.array([x[1] for x in q])) @ unit(np.array([x[1] for x in c])).T, 12)
    s = s if decimals is None else positives.half_up(s, decimals)
    for i, (query, _, label) in enumerate(q):
        y = np.array([label is not None and x[2] == label for x in c], int)
        out[query] = (int(y.sum()), int(len(y) - y.sum()), metrics_ref.eer(y, s[i]), metrics_ref.ap(y, s[i]))
    return out


@pytest.mark.parametrize("kind", ["ties", "few", "random"])
def test_matches_numpy(spark, kind):
    rng = np.random.default_rng(len(kind))
    if kind == "random":
        vectors, labels, n = rng.standard_normal((400, 6)), 4, 90
    else:  # entries of +-0.5 in eight places: scores tie at multiples of an eighth
        vectors, labels, n = rng.choice([-0.5, 0.5], (64, 8)), {"ties": 3, "few": 25}[kind], 130
    dq, dc, q, c = _frames(spark, rng, 60, n, labels, vectors)
    out = positives.evaluate_vectors(dq, dc, runs=(("a", None), ("b", 1)), block_rows=32).collect()
    assert len(out) == 2 * len(q)
    for run, decimals in (("a", None), ("b", 1)):
        want = _reference(q, c, decimals)
        for r in out:
            if r.run_id == run:
                p, n, eer, ap = want[r.query_id]
                assert (r.n_pos, r.n_neg) == (p, n) and r.ap == pytest.approx(ap)
                assert (r.eer is None) == (eer is None) and (eer is None or r.eer == pytest.approx(eer))


def test_rounds_of_a_block_per_core(spark, monkeypatch):
    """Where a cell would keep too many positives, the queries take several
    rounds: at most three copies of the candidates per core at a time, every
    query once, the results of one round, and only they on disk."""
    import os

    from quire.operators import streams
    from quire.session import scratch_path

    dq, dc, q, c = _frames(spark, np.random.default_rng(9), 60, 130, 3, np.random.default_rng(9).choice([-0.5, 0.5], (64, 8)))
    runs, cores = (("a", None), ("b", 1)), spark.sparkContext.defaultParallelism
    want = sorted(map(tuple, positives.evaluate_vectors(dq, dc, runs=runs).collect()), key=str)
    tables = os.path.dirname(scratch_path(spark, "none")).removeprefix("file:")
    before, seen = set(os.listdir(tables)), []
    monkeypatch.setattr(positives, "pass_by", lambda held, passing, *a, **kw: seen.append((held.count(), passing.count())) or streams.pass_by(held, passing, *a, **kw))
    monkeypatch.setattr(positives, "POSITIVES", 4 * max(sum(x[2] == y for x in c) for y in range(3)))
    rows = positives.evaluate_vectors(dq, dc, runs=runs)
    assert len(seen) == -(-15 // cores) > 1 and sum(n for n, _ in seen) == 60 and {n for _, n in seen} == {cores * 130}
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(tables)) - before} <= {"evaluated", "stable"}
    got = sorted(map(tuple, rows.collect()), key=str)
    assert [x[:4] for x in got] == [x[:4] for x in want]
    assert [v for x in got for v in x[4:]] == [v if v is None else pytest.approx(v) for x in want for v in x[4:]]


def test_counts_go_by_the_batch(monkeypatch):
    """Negatives are looked up among the thresholds, not all thresholds in
    every batch, and only pairs of equal labels are scored for positives."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    rows = lambda n: pa.RecordBatch.from_pydict({"q": list(range(n)), "v": [[float(x) for x in rng.choice([-0.5, 0.5], 8)] for _ in range(n)], "label": [None if x == 3 else int(x) for x in rng.integers(0, 4, n)]})
    mine, theirs = rows(12), [rows(300), rows(5), rows(1)]
    held, made = positives.HeldQueries(mine, [None, 1]), []
    monkeypatch.setattr(positives, "matching", lambda a, b: made.append(len(a) * len(b)) or a @ b.T)
    for batch in theirs:
        held.add_positives(batch)
    assert sum(made) == sum(x == y for x in mine["label"].to_pylist() if x is not None for b in theirs for y in b["label"].to_pylist())
    held.close_positives()
    for batch in theirs:
        held.add_negatives(batch)
    unit = lambda b: np.array(b["v"].to_pylist()) / np.sqrt(2.0)
    for g, label in enumerate(mine["label"].to_pylist()):
        s = positives.half_up(np.concatenate([unit(b) @ unit(mine)[g] for b in theirs]), 12)
        y = np.array([label is not None and x == label for b in theirs for x in b["label"].to_pylist()])
        for r, x in enumerate((s, positives.half_up(s, 1))):
            t = np.unique(x[y])
            assert list(held.t[g][r]) == list(t)
            assert list(held.places[g][r][1::2]) == [int((x[~y] == v).sum()) for v in t]
            assert list(np.cumsum(held.places[g][r])[::2]) == [int((x[~y] < v).sum()) for v in t] + [int((~y).sum())]


def test_point_inside_an_interval(spark):
    """The best point is a negative threshold between two positives, where the
    number of tied negatives changes."""
    angles = [0.0] * 1 + [0.1] * 2 + [0.2] * 2 + [0.3, 0.4, 0.5, 0.6] + [0.7] * 1
    truth = [1] + [0] * 8 + [1]
    c = spark.createDataFrame([(i, [float(np.cos(a)), float(np.sin(a))], t) for i, (a, t) in enumerate(zip(angles, truth))], "candidate_id long, vec array<double>, label int")
    q = spark.createDataFrame([(0, [1.0, 0.0], 1)], "query_id long, vec array<double>, label int")
    (row,) = positives.evaluate_vectors(q, c).collect()
    s = np.cos(angles)
    assert positives.known_points(s[np.array(truth) == 1], np.array([2]), np.array([8]))[7] is not None
    assert row.eer == pytest.approx(metrics_ref.eer(truth, s)) and row.eer == pytest.approx(0.5)


def test_empty_sides(spark):
    rng = np.random.default_rng(1)
    dq, dc, _, _ = _frames(spark, rng, 3, 3, 2, rng.standard_normal((5, 4)))
    assert positives.evaluate_vectors(dq.limit(0), dc).collect() == []
    got = positives.evaluate_vectors(dq, dc.limit(0)).collect()
    assert [(r.n_pos, r.n_neg, r.eer, r.ap) for r in got] == [(0, 0, None, 0.0)] * 3


def test_same_as_the_curve_over_all_scores(spark):
    rng = np.random.default_rng(8)
    dq, dc, _, _ = _frames(spark, rng, 40, 70, 3, rng.standard_normal((200, 5)))
    dq, dc = dq.where("label IS NOT NULL"), dc.where("label IS NOT NULL")
    want = {r.query_id: r for r in scoring.evaluate_attribution(scoring.scored_with_truth(dq, dc))[0].collect()}
    for r in positives.evaluate_vectors(dq, dc).collect():
        w = want[r.query_id]
        assert (r.n_pos, r.n_neg) == (w.n_pos, w.n_neg) and r.ap == pytest.approx(w.ap) and (r.eer is None and w.eer is None or r.eer == pytest.approx(w.eer))


def test_rounds_leave_no_pairs(spark):
    """All pairs of separate score and truth tables, a share of the queries at
    a time: the same metrics, and no table of pairs stays on disk."""
    import os

    from quire.operators.metrics import attach_truth
    from quire.session import ensure_checkpoint_dir, scratch_path

    dq, dc, q, c = _frames(spark, np.random.default_rng(8), 40, 50, 3, np.eye(4))
    dq, dc = dq.fillna(9, "label"), dc.fillna(9, "label")
    rounds = []

    def aligned(some, candidates):
        rounds.append(some.count())
        truth = scoring.scored_with_truth(some, candidates).select("query_id", "candidate_id", "label")
        return attach_truth(scoring.score_query_candidates(some, candidates), truth)

    tables = os.path.dirname(scratch_path(spark, "none")).removeprefix("file:")
    assert tables.startswith(ensure_checkpoint_dir(spark).removeprefix("file:"))
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = set(os.listdir(tables)) if os.path.exists(tables) else set(), spark.conf.get(cleanup)
    pq, macro = scoring.evaluate_in_rounds(dq, dc, aligned, pairs=600)
    assert len(rounds) == 4 and sum(rounds) == 40 and max(rounds) < 40
    assert [x.rsplit("-", 1)[0] for x in set(os.listdir(tables)) - before] == ["per_query"]
    assert spark.conf.get(cleanup) == was
    want, total = scoring.evaluate_attribution(aligned(dq, dc))
    assert sorted(map(tuple, pq.collect())) == sorted(tuple(r) for r in want.select(pq.columns).collect())
    assert macro.first().n_queries == total.first().n_queries == 40
    assert macro.first().mean_ap == pytest.approx(total.first().mean_ap)
    # no queries at all: one round without rows
    assert scoring.evaluate_in_rounds(dq.limit(0), dc, aligned)[1].first().n_queries == 0


def test_stored_runs_keep_their_tables(spark, tmp_path):
    """Scores of two runs and the truth, stored a share of the queries at a
    time: the tables hold every pair and stay, the other tables do not, and
    the comparison is that of all pairs at once."""
    import os

    from pyspark.sql import functions as F

    from quire.session import scratch_path

    dq, dc, q, c = _frames(spark, np.random.default_rng(8), 40, 50, 3, np.eye(4))
    dq, dc = dq.fillna(9, "label"), dc.fillna(9, "label")
    tables = os.path.dirname(scratch_path(spark, "none")).removeprefix("file:")
    before = set(os.listdir(tables)) if os.path.exists(tables) else set()
    pq, macro = scoring.compare_stored_runs(dq, dc, f"{tmp_path}/kept", pairs=600)
    assert [x.rsplit("-", 1)[0] for x in set(os.listdir(tables)) - before] == ["per_query"]

    scored = scoring.scored_with_truth(dq, dc)
    kept, truth = spark.read.parquet(f"{tmp_path}/kept/scores"), spark.read.parquet(f"{tmp_path}/kept/truth")
    assert truth.select("share").distinct().count() == 4
    assert {r.run_id: r["count"] for r in kept.groupBy("run_id").count().collect()} == {"exact": 2000, "rounded": 2000}
    pairs = lambda df, v: sorted(map(tuple, df.select("query_id", "candidate_id", v).collect()))
    assert pairs(kept.where("run_id = 'exact'"), "score") == pairs(scored, "score")
    assert pairs(kept.where("run_id = 'rounded'"), "score") == pairs(scored.withColumn("score", F.round("score", 1)), "score")
    assert pairs(truth, "label") == pairs(scored, "label")

    want = {r.run_id: r for r in scoring.compare_runs(scoring.two_runs(scored)).collect()}
    got = {r.run_id: r for r in macro.collect()}
    assert set(got) == set(want) and pq.count() == 80
    for run, r in got.items():
        assert (r.n_queries, r.n_undefined) == (want[run].n_queries, want[run].n_undefined) == (40, want[run].n_undefined)
        assert (r.mean_eer, r.mean_ap) == (pytest.approx(want[run].mean_eer), pytest.approx(want[run].mean_ap))
    # no queries at all: tables without rows, no run to compare
    assert scoring.compare_stored_runs(dq.limit(0), dc, f"{tmp_path}/none")[1].collect() == []
    assert spark.read.parquet(f"{tmp_path}/none/truth").count() == 0
