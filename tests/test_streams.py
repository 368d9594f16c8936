"""Cells that hold a block while the other side passes by: results in small
batches, and copies that grow with the input only."""

import numpy as np
import pytest

from quire.operators import positives, streams
from tests.test_positives import _frames, _reference


@pytest.fixture
def small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, "7")
    yield
    spark.conf.set(key, was)


def _copies(monkeypatch, module, run):
    """Rows that pass by while ``run`` is called."""
    seen = []
    monkeypatch.setattr(module, "pass_by", lambda held, passing, cell, n, *a, **kw: seen.append(passing.count() * kw.get("phases", 1)) or streams.pass_by(held, passing, cell, n, *a, **kw))
    run()
    return sum(seen)


def test_cells():
    assert streams.n_cells(0, 8) == 1 and streams.n_cells(3, 8) == 3
    assert streams.n_cells(10_000, 8) == streams.n_cells(100_000, 8) == 8
    assert streams.n_cells(1000, 8, held_rows=10) == 100
    assert [(s.start, s.stop) for s in streams.tiles(5, 10, most=20)] == [(0, 2), (2, 4), (4, 5)]


def test_evaluation_copies_candidates_per_core_only(spark, monkeypatch):
    cores, rng = spark.sparkContext.defaultParallelism, np.random.default_rng(1)
    for n in (40, 160):
        q, c, _, _ = _frames(spark, rng, n, 2 * n, 3, rng.standard_normal((50, 4)))
        assert _copies(monkeypatch, positives, lambda: positives.evaluate_vectors(q, c)) == 3 * cores * 2 * n


def test_evaluation_in_small_batches_and_of_repeated_ids(spark, small_batches):
    rng = np.random.default_rng(2)
    dq, dc, q, c = _frames(spark, rng, 30, 60, 3, rng.choice([-0.5, 0.5], (64, 8)))
    got = {r.query_id: r for r in positives.evaluate_vectors(dq, dc).collect()}
    for x, (n_pos, n_neg, eer, ap) in _reference(q, c, None).items():
        r = got[x]
        assert (r.n_pos, r.n_neg) == (n_pos, n_neg) and r.ap == pytest.approx(ap) and (eer is None or r.eer == pytest.approx(eer))
    rows = positives.evaluate_vectors(dq.union(dq), dc).collect()
    twice = {r.query_id: r for r in rows}
    assert len(rows) == 60 and all((r.n_pos, r.n_neg) == (2 * got[x].n_pos, 2 * got[x].n_neg) and r.ap == pytest.approx(got[x].ap) for x, r in twice.items()) and len(twice) == 30


def test_scores_copy_candidates_per_core_only(spark, monkeypatch, small_batches):
    from quire.operators import similarity

    cores, rng = spark.sparkContext.defaultParallelism, np.random.default_rng(3)
    for n in (40, 160):
        q, c, _, _ = _frames(spark, rng, n, 2 * n, 3, rng.standard_normal((50, 4)))
        assert _copies(monkeypatch, similarity, lambda: similarity.score_query_candidates(q, c)) == cores * 2 * n
    assert similarity.score_query_candidates(q, c).distinct().count() == 160 * 320
    best = similarity.score_query_candidates(q, c, top_k=3).collect()
    assert len(best) == 3 * 160 and {r["rank"] for r in best} == {1, 2, 3}


@pytest.mark.parametrize("emit", ["pairs", "max"])
def test_author_copies_follow_the_cores(spark, monkeypatch, small_batches, emit):
    """Every pair of a large author once, the earlier document first, and a
    document's copies bounded by the blocks, two per core."""
    from quire.operators import similarity

    cores, rng = spark.sparkContext.defaultParallelism, np.random.default_rng(4)
    for n in (100, 400):
        v = rng.integers(0, 3, (n, 6)).astype(float)
        docs = spark.createDataFrame([("a", i, n - i, x.tolist()) for i, x in enumerate(v)], "author_id string, doc_id long, seq long, vec array<double>")
        run = lambda: similarity.author_pairs(docs, emit=emit, block_rows=2)
        assert _copies(monkeypatch, similarity, run) <= (2 * cores - 1) * n
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    s = unit @ unit.T
    got = run().toPandas()
    if emit == "max":
        assert got.max_sim.tolist() == [pytest.approx(s[np.triu_indices(n, 1)].max())]
    else:
        assert len(got) == n * (n - 1) // 2 and not got.duplicated(["doc_i", "doc_j"]).any() and (got.doc_i > got.doc_j).all()
        assert np.allclose(got.sim, s[got.doc_i, got.doc_j])


def test_whole_number_products_are_exact():
    from quire.operators.similarity import _cosines, _scaled

    rng = np.random.default_rng(5)
    for m in (rng.integers(0, 50, (20, 30)).astype(float), 3000 * rng.integers(0, 50, (20, 30)).astype(float), rng.standard_normal((20, 30))):
        m[0] = 0
        n = np.linalg.norm(m, axis=1)
        want = m @ m.T / np.maximum(n[:, None] * n[None, :], 1e-12)
        assert np.allclose(_cosines(_scaled(m), _scaled(m)), want, rtol=1e-14, atol=1e-15)
        assert np.allclose(_cosines(_scaled(m), (np.nan_to_num(m / np.where(n, n, 1)[:, None]), None)), want)


def test_one_batch_loss_copies_rows_per_core_only(spark, monkeypatch, small_batches):
    from quire.operators import losses

    cores, rng = spark.sparkContext.defaultParallelism, np.random.default_rng(6)
    for n in (40, 160):
        rows = spark.createDataFrame([(0, int(x), rng.standard_normal(4).tolist()) for x in rng.integers(0, 4, n)], "batch_id long, label int, vec array<double>")
        assert _copies(monkeypatch, losses, lambda: losses.tiled_multi_positive_loss(rows)) == cores * n
    got, want = losses.tiled_multi_positive_loss(rows).first(), losses.multi_positive_loss(rows).first()
    assert got.n == want.n == 160 and got.loss == pytest.approx(want.loss)
