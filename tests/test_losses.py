import numpy as np
import pytest

from quire.operators.losses import (
    multi_positive_loss,
    symmetric_ranking_loss,
    tiled_multi_positive_loss,
    tiled_ranking_loss,
)


def _norm(m):
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _lse(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def test_symmetric_ranking_loss_matches_numpy(spark):
    rng = np.random.default_rng(0)
    a, p = rng.normal(size=(37, 5)), rng.normal(size=(37, 5))
    a[3] = 0.0  # zero vector
    batch = np.arange(37) // 16  # partial last batch of 5
    rows = [(int(b), x.tolist(), y.tolist()) for b, x, y in zip(batch, a, p)]
    df = spark.createDataFrame(rows, "batch_id bigint, anchor_vec array<double>, positive_vec array<double>")
    out = symmetric_ranking_loss(df).toPandas().set_index("batch_id")
    for b in np.unique(batch):
        s = 20 * _norm(a[batch == b]) @ _norm(p[batch == b]).T
        d = np.diag(s)
        ref = (np.mean(_lse(s, 1) - d) + np.mean(_lse(s, 0) - d)) / 2
        assert out.loc[b, "loss"] == pytest.approx(ref, rel=1e-12)
        assert out.loc[b, "n"] == (batch == b).sum()


def test_multi_positive_loss_matches_numpy(spark):
    rng = np.random.default_rng(1)
    n = 70
    f = rng.normal(size=(n, 6))
    labels = rng.integers(0, 4, n)
    batch = np.r_[np.zeros(64, int), np.ones(5, int), [2]]  # includes a batch of one
    rows = [(int(b), int(lab), x.tolist()) for b, lab, x in zip(batch, labels, f)]
    df = spark.createDataFrame(rows, "batch_id bigint, label int, vec array<double>")
    out = multi_positive_loss(df).toPandas().set_index("batch_id")
    for b in np.unique(batch):
        x = _norm(f[batch == b])
        lab = labels[batch == b]
        m = len(x)
        loss = np.zeros(m)
        for i in range(m):
            others = [j for j in range(m) if j != i]
            if not others:
                continue
            s = np.array([x[i] @ x[j] / 0.1 for j in others])
            logq = s - _lse(s, 0)
            pos = np.array([lab[i] == lab[j] for j in others], float)
            if pos.sum():
                loss[i] = -(pos / pos.sum() * logq).sum()
        assert out.loc[b, "loss"] == pytest.approx(loss.mean(), abs=1e-9)
    assert out.loc[2, "loss"] == 0.0


def test_ranking_loss_negatives_widen_forward_only(spark):
    rng = np.random.default_rng(2)
    a, p, n = (rng.normal(size=(10, 4)) for _ in range(3))
    rows = [(0, x.tolist(), y.tolist(), z.tolist()) for x, y, z in zip(a, p, n)]
    df = spark.createDataFrame(rows, "batch_id bigint, anchor_vec array<double>, positive_vec array<double>, neg array<double>")
    got = symmetric_ranking_loss(df, negatives=("neg",)).first()["loss"]
    s = 20 * _norm(a) @ _norm(p).T
    w = np.hstack([s, 20 * _norm(a) @ _norm(n).T])
    d = np.diag(s)
    ref = (np.mean(_lse(w, 1) - d) + np.mean(_lse(s, 0) - d)) / 2
    assert got == pytest.approx(ref, rel=1e-12)


def _by_batch(df):
    return {r["batch_id"]: (r["n"], r["loss"]) for r in df.collect()}


def _equal(got, want):
    assert got.keys() == want.keys()
    for b, (n, loss) in want.items():
        assert got[b][0] == n
        assert got[b][1] == pytest.approx(loss, abs=1e-9)


@pytest.mark.parametrize("similarity", ["cosine", "dot"])
@pytest.mark.parametrize("block_rows", [1, 7, 100])
def test_tiles_merge_to_the_ranking_loss_of_whole_batches(spark, similarity, block_rows):
    rng = np.random.default_rng(5)
    a, p = rng.normal(size=(33, 4)), rng.normal(size=(33, 4))
    vec = lambda x, i: None if i == 4 else x.tolist()
    rows = [(int(i >= 30), vec(x, i), y.tolist()) for i, (x, y) in enumerate(zip(a, p))]
    rows += [(7, [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 0.0])] + [(9, [0.5] * 4, [0.5] * 4)] * 3  # one pair, repeated rows
    df = spark.createDataFrame(rows, "batch_id bigint, anchor_vec array<double>, positive_vec array<double>")
    tiled = tiled_ranking_loss(df, similarity=similarity, block_rows=block_rows)
    _equal(_by_batch(tiled), _by_batch(symmetric_ranking_loss(df, similarity=similarity)))


@pytest.mark.parametrize("block_rows", [1, 7, 100])
def test_tiles_merge_to_the_multi_positive_loss_of_whole_batches(spark, block_rows):
    rng = np.random.default_rng(6)
    f = rng.normal(size=(40, 5))
    rows = [(int(i >= 36), int(lab), x.tolist()) for i, (lab, x) in enumerate(zip(rng.integers(0, 5, 40), f))]
    rows += [(5, 1, [1.0, 0.0, 0.0, 0.0, 0.0]), (6, 2, [0.0] * 5), (6, 2, None), (6, 3, [1.0] * 5)]  # a batch of one, zero and null vectors
    df = spark.createDataFrame(rows, "batch_id bigint, label int, vec array<double>")
    _equal(_by_batch(tiled_multi_positive_loss(df, block_rows=block_rows)), _by_batch(multi_positive_loss(df)))


def test_tiled_losses_of_no_rows(spark):
    assert tiled_ranking_loss(spark.createDataFrame([], "batch_id bigint, anchor_vec array<double>, positive_vec array<double>")).count() == 0
    assert tiled_multi_positive_loss(spark.createDataFrame([], "batch_id bigint, label int, vec array<double>")).count() == 0
