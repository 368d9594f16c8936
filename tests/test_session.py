from quire.session import ensure_checkpoint_dir, scratch_path, stable


def test_checkpoint_dir_is_reused(spark):
    first = ensure_checkpoint_dir(spark)
    assert first and ensure_checkpoint_dir(spark) == first
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(first.rstrip("/"))


def test_stable_round_trips_rows(spark):
    df = spark.range(100).selectExpr("id", "id * 2 AS twice")
    out = stable(df)
    assert sorted(tuple(r) for r in out.collect()) == [(i, 2 * i) for i in range(100)]
