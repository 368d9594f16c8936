import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.operators.similarity import author_pairs
from quire.operators.witness import authors_below
from quire.plans import diversity
from tests.conftest import SF001


def _docs(spark, rows):
    pdf = pd.DataFrame(rows, columns=["author_id", "doc_id", "seq", "vec"])
    return spark.createDataFrame(pdf, "author_id string, doc_id bigint, seq bigint, vec array<double>")


def test_strict_threshold_and_zero_vector(spark):
    rows = [
        ("orth", 1, 1, [1.0, 0.0]),
        ("orth", 2, 2, [0.0, 1.0]),  # similarity exactly 0
        ("zero", 3, 1, [0.0, 0.0]),
        ("zero", 4, 2, [1.0, 1.0]),  # zero vector -> 0, not NaN
        ("single", 5, 1, [1.0, 0.0]),  # one document: no pairs, not judged
        ("same", 6, 1, [1.0, 2.0]),
        ("same", 7, 2, [2.0, 4.0]),
    ]
    d = _docs(spark, rows)
    mx = {r["author_id"]: r["max_sim"] for r in diversity.author_max_similarity(d).collect()}
    assert set(mx) == {"orth", "zero", "same"}
    assert mx["orth"] == 0.0 and mx["zero"] == 0.0
    assert mx["same"] == pytest.approx(1.0)
    # strict: an author whose max equals the threshold is dropped
    _, keep = diversity.diverse_authors(d, threshold=0.0)
    assert keep.count() == 0
    _, keep = diversity.diverse_authors(d, threshold=0.5)
    assert sorted(r[0] for r in keep.collect()) == ["orth", "zero"]


def test_blocked_pairs_equal_plain(spark):
    rng = np.random.default_rng(1)
    rows = []
    # one prolific author (a third of the rows) and many small ones
    for i in range(60):
        rows.append(("hot", i, i, rng.normal(size=8).tolist()))
    for a in range(40):
        for j in range(int(rng.integers(1, 5))):
            rows.append((f"a{a}", 1000 + a * 10 + j, j, rng.normal(size=8).tolist()))
    d = _docs(spark, rows)
    plain = author_pairs(d, block_rows=10_000).toPandas()  # every author packed
    blocked = author_pairs(d, block_rows=7, pack_rows=5).toPandas()  # cells, and many small packs
    key = ["author_id", "doc_i", "doc_j"]
    m = plain.merge(blocked, on=key, suffixes=("_p", "_b"))
    assert len(plain) == len(blocked) == len(m)
    assert np.allclose(m["sim_p"], m["sim_b"])
    assert len(plain[plain.author_id == "hot"]) == 60 * 59 // 2
    mx_plain = author_pairs(d, block_rows=10_000, emit="max").toPandas().set_index("author_id")
    mx_blocked = author_pairs(d, block_rows=7, emit="max", pack_rows=5).toPandas().set_index("author_id")
    assert np.allclose(mx_plain.sort_index()["max_sim"], mx_blocked.sort_index()["max_sim"])


def test_retained_authors_have_all_pairs_below(spark):
    from quire.sources import fixtures as fx

    docs = fx.fx_vectors(spark, SF001)
    info, keep = diversity.diverse_authors(docs, threshold=0.2)
    pairs = diversity.author_pair_similarity(docs)
    bad = pairs.join(keep, "author_id", "left_semi").where(F.col("sim") >= 0.2).count()
    assert bad == 0
    assert keep.count() == 92  # FIXTURES.md: 92 of 125 at sf0.01


def test_cap_is_seeded_and_bounded(spark):
    from quire.sources import fixtures as fx

    docs = fx.fx_vectors(spark, SF001)
    _, k1 = diversity.diverse_authors(docs, cap=10, seed=5)
    _, k2 = diversity.diverse_authors(docs, cap=10, seed=5)
    _, k3 = diversity.diverse_authors(docs, cap=10, seed=6)
    a, b, c = (sorted(r[0] for r in k.collect()) for k in (k1, k2, k3))
    assert len(a) == 10 and a == b and a != c


def test_similarity_exactly_at_threshold_is_dropped(spark):
    # cos((1,0,0,0), (1,4,2,2)) = 1 / 5 exactly
    d = _docs(spark, [("eq", 1, 1, [1.0, 0.0, 0.0, 0.0]), ("eq", 2, 2, [1.0, 4.0, 2.0, 2.0]),
                      ("lo", 3, 1, [1.0, 0.0, 0.0, 0.0]), ("lo", 4, 2, [0.0, 1.0, 0.0, 0.0])])
    mx = {r["author_id"]: r["max_sim"] for r in diversity.author_max_similarity(d).collect()}
    assert mx["eq"] == 0.2
    _, keep = diversity.diverse_authors(d, threshold=0.2)
    assert [r[0] for r in keep.collect()] == ["lo"]


def test_repeated_document_ids_are_not_collapsed(spark):
    d = _docs(spark, [("r", 7, 1, [1.0, 0.0]), ("r", 7, 2, [0.0, 1.0]), ("r", 8, 3, [1.0, 1.0])])
    pairs = diversity.author_pair_similarity(d).collect()
    assert len(pairs) == 3
    assert sorted((p["doc_i"], p["doc_j"]) for p in pairs) == [(7, 7), (7, 8), (7, 8)]


def _plain_below(docs, threshold, **kw):
    mx = author_pairs(docs, emit="max", **kw).where(F.col("max_sim") < threshold)
    return {r["author_id"]: r["max_sim"] for r in mx.collect()}


def test_authors_below_equals_all_pairs(spark):
    """With small blocks every step runs; null vectors, authors with a single
    near copy, a null author and repeated rows included."""
    rng = np.random.default_rng(3)
    rows = []
    eye = np.eye(64)
    for i in range(40):  # alike everywhere: dropped by one block
        rows.append(("alike", i, i, (eye[0] + 0.01 * rng.normal(size=64)).tolist()))
    for i in range(40):  # orthogonal but for one near copy
        rows.append(("copy", 100 + i, i, eye[i].tolist()))
    rows.append(("copy", 199, 99, (eye[7] + 0.05 * eye[50]).tolist()))
    for i in range(40):  # nothing alike: all pairs, exact maximum
        rows.append(("apart", 200 + i, i, (eye[i] + 0.05 * eye[(i + 1) % 40]).tolist()))
    rows += [("nulls", 300 + i, i, None) for i in range(20)]
    rows += [("small", 400, 0, eye[1].tolist()), ("small", 401, 1, eye[2].tolist())]
    rows += [("one", 500, 0, eye[1].tolist()), (None, 501, 0, eye[1].tolist()), (None, 502, 1, eye[1].tolist())]
    d = _docs(spark, rows)
    steps = []
    got = {r[0]: r[1] for r in authors_below(d, 0.2, block_rows=8, steps=steps).collect()}
    want = _plain_below(d, 0.2, block_rows=10_000)
    assert set(got) == set(want) == {"apart", "nulls", "small"}
    assert all(abs(got[a] - want[a]) < 1e-12 for a in want)
    assert [s for s, _ in steps] == ["one block", "neighbours"]
    assert sum(n for _, n in steps) == 2  # both similar authors go before all pairs


def test_authors_below_on_random_authors(spark):
    rng = np.random.default_rng(9)
    rows = []
    for a in range(12):
        spread = rng.uniform(0.1, 4.0)
        base = rng.normal(size=16)
        for j in range(int(rng.integers(1, 40))):
            rows.append((f"r{a}", a * 100 + j, j, (base + spread * rng.normal(size=16)).tolist()))
    d = _docs(spark, rows)
    for t in (0.0, 0.8):
        got = {r[0]: r[1] for r in authors_below(d, t, block_rows=5).collect()}
        want = _plain_below(d, t)
        assert set(got) == set(want)
        assert all(abs(got[a] - want[a]) < 1e-12 for a in want)


def test_author_with_fifty_thousand_documents_is_dropped_by_one_block(spark):
    """The author is whole (not thinned); all its pairs would be 1.25 billion."""
    vec = F.transform(
        F.sequence(F.lit(1), F.lit(8)), lambda k: (F.xxhash64(F.col("id"), k) % 1000) / F.lit(1000.0) + F.lit(0.2)
    )
    hot = spark.range(50_000).select(F.lit("hot").alias("author_id"), F.col("id").alias("doc_id"), F.col("id").alias("seq"),
                                     vec.alias("vec"))
    few = _docs(spark, [("few", 1, 1, [1.0] + [0.0] * 7), ("few", 2, 2, [0.0, 1.0] + [0.0] * 6)])
    steps = []
    got = authors_below(hot.unionByName(few), 0.2, steps=steps).collect()
    assert [(r[0], r[1]) for r in got] == [("few", 0.0)]
    assert steps == [("one block", 1)]


def test_authors_below_of_empty_input(spark):
    assert authors_below(_docs(spark, [("x", 1, 1, [1.0])]).limit(0), 0.2).count() == 0


def test_cells_without_a_pair_and_string_authors(spark):
    """A hash block of one document has no pair with itself."""
    d = _docs(spark, [("s", i, i, [1.0, float(i)]) for i in range(7)])
    assert author_pairs(d, block_rows=1).count() == 21
    assert author_pairs(d, block_rows=1, emit="max").count() == 1


@pytest.mark.parametrize("kind", ["copy", "near", "none", "zero"])
def test_largest_similarity_leaves_out_what_cannot_be_it(spark, monkeypatch, kind):
    """Of a large author: the maximum of all pairs, while documents pass by
    other blocks only where a better pair may lie; not at all beside a copy."""
    from quire.operators import similarity, streams

    rng = np.random.default_rng(len(kind))
    n = 240
    v = rng.standard_normal((n, 6))
    if kind in ("copy", "near"):
        v[200] = 3.0 * v[10] + (0 if kind == "copy" else 1e-3 * rng.standard_normal(6))
    if kind == "none":  # unlike in pairs: the bound excludes little
        v = np.vstack([np.eye(n // 2), -np.eye(n // 2)])
    rows = [("a", i, n - i, x.tolist()) for i, x in enumerate(v)]
    if kind == "zero":
        rows = [(a, i, s, None if i % 2 else [0.0] * 6) for a, i, s, _ in rows]
        v = np.zeros((n, 6))
    docs = spark.createDataFrame(rows + [("b", 1000, 0, [1.0] * len(v[0])), ("b", 1001, 1, [1.0] * len(v[0]))], "author_id string, doc_id long, seq long, vec array<double>")
    passed = []
    monkeypatch.setattr(similarity, "pass_by", lambda held, passing, *a, **kw: passed.append(passing.count()) or streams.pass_by(held, passing, *a, **kw))
    got = {r.author_id: r.max_sim for r in author_pairs(docs, emit="max", block_rows=20).collect()}
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    assert got == {"a": pytest.approx((unit @ unit.T)[np.triu_indices(n, 1)].max(), abs=1e-12), "b": pytest.approx(1.0)}
    everything = n * (2 * spark.sparkContext.defaultParallelism - 1) / 2  # eight blocks, each passed by all later ones
    if kind == "copy":
        assert passed == [0]
    elif kind == "near":
        assert len(passed) == 1 or sum(passed) < everything / 4
    else:
        assert passed[0] == 0 and 0 < sum(passed) <= everything
