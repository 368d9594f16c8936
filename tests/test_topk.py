import numpy as np
import pytest

from quire.operators import topk

SCHEMA = "id long, vec array<double>"


def _side(spark, vecs, first=0):
    rows = [(first + i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vecs)]
    return spark.createDataFrame(rows, SCHEMA)


def _brute(qs, cs, k, first):
    def unit(v):
        v = np.zeros(4) if v is None else np.asarray(v, float)
        n = np.linalg.norm(v)
        return v / n if n else v

    out = {}
    for i, q in enumerate(qs):
        scored = sorted((-round(float(unit(q) @ unit(c)), 9), first + j) for j, c in enumerate(cs))
        out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def _run(spark, qs, cs, k, **kw):
    q = _side(spark, qs).withColumnRenamed("id", "query_id")
    c = _side(spark, cs, 1000).withColumnRenamed("id", "candidate_id")
    return topk.nearest_candidates(q, c, k, **kw)


def _lists(result):
    got = {}
    for r in sorted(result.rows.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["candidate_id"], r["score"]))
    return got


def _same(got, want):
    assert got.keys() == {i for i, rows in want.items() if rows}
    for i, rows in got.items():
        assert [s for _, s in rows] == pytest.approx([s for _, s in want[i]], abs=1e-9)
        assert [j for j, _ in rows] == [j for j, _ in want[i]]


def test_clustered_vectors_skip_cells_and_lose_nothing(spark):
    rng = np.random.default_rng(3)
    centres = np.vstack([np.eye(4), -np.eye(4)])
    at = rng.integers(0, 8, 400)
    cs = centres[at] + rng.normal(0, 0.02, (400, 4))
    qs = centres[rng.integers(0, 8, 60)] + rng.normal(0, 0.02, (60, 4))
    found = _run(spark, qs, cs, 5, pivots=8, block_rows=16, query_rows=8)
    _same(_lists(found), _brute(qs, cs, 5, 1000))
    # the queries' own cluster is at most a quarter of all cells
    assert found.cells.count() < found.n_cells / 4
    assert found.cells.distinct().count() == found.cells.count()


def test_vectors_without_clusters_and_one_hot_cluster(spark):
    rng = np.random.default_rng(4)
    cs = np.vstack([rng.normal(size=(80, 4)), np.array([1, 0, 0, 0]) + rng.normal(0, 1e-3, (120, 4))])
    qs = np.vstack([rng.normal(size=(20, 4)), [[1, 0, 0, 0]]])
    for k in (1, 7, 150):
        _same(_lists(_run(spark, qs, cs, k, pivots=6, block_rows=16, query_rows=8)), _brute(qs, cs, k, 1000))


def test_ties_zero_null_and_few_candidates(spark):
    cs = [[1, 0, 0, 0]] * 6 + [[0, 0, 0, 0], None, [-1, 0, 0, 0]]
    qs = [[2, 0, 0, 0], [0, 0, 0, 0], None, [-3, 0, 0, 0]]
    for k in (1, 3, 8, 20):
        _same(_lists(_run(spark, qs, cs, k, pivots=3, block_rows=2, query_rows=2)), _brute(qs, cs, k, 1000))


def test_all_zero_vectors(spark):
    _same(_lists(_run(spark, [[0, 0, 0, 0], [1, 0, 0, 0]], [[0, 0, 0, 0], None], 2)), _brute([[0] * 4, [1, 0, 0, 0]], [[0] * 4, None], 2, 1000))


def test_empty_sides(spark):
    assert _run(spark, [], [[1, 0, 0, 0]], 3).rows.count() == 0
    assert _run(spark, [[1, 0, 0, 0]], [], 3).rows.count() == 0


def test_tiles_give_what_one_product_gives():
    rng = np.random.default_rng(8)
    a, b = rng.integers(-2, 3, (9, 3)).astype(float), rng.integers(-2, 3, (50, 3)).astype(float)  # many ties
    ids = rng.permutation(50)
    floor = np.where(np.arange(9) % 3 == 0, 2.0, topk.NO_SCORE * 10)
    for k in (1, 4, 60):
        want = [(i, j, s) for i in range(9) for s, j in sorted(((a[i] @ b[c], ids[c]) for c in range(50)), key=lambda x: (-x[0], x[1]))[:k] if s >= floor[i]]
        for tile in (1, 7, 50):
            assert list(zip(*topk._best(a, b, ids, k, floor, tile))) == want
