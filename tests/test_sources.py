import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.sources import jsonl, matrices


def _write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_corpus_scan_prefix_and_filtered_names(spark, tmp_path):
    base = tmp_path / "filtered_runs" / "corpus"  # a directory name with 'filtered' hides nothing
    _write(base / "dev_queries.jsonl", [{"documentID": "d1", "fullText": "x", "authorIDs": ["a"]}])
    _write(base / "dev2_candidates.jsonl", [{"documentID": "d2", "fullText": "y", "authorIDs": ["b", "c"], "extra": 1}])
    _write(base / "dev_queries_filtered.jsonl", [{"documentID": "old", "fullText": "z", "authorIDs": ["a"]}])
    _write(base / "train_queries.jsonl", [{"documentID": "t", "fullText": "z", "authorIDs": ["a"]}])
    df = jsonl.read_corpus(spark, str(base), "dev")
    got = sorted((r["documentID"], r["authorID"]) for r in df.collect())
    assert got == [("d1", "a"), ("d2", "b")]


def test_official_files_need_exactly_one_match(spark, tmp_path):
    _write(tmp_path / "x" / "data" / "r_input_queries.jsonl", [{"fullText": "q", "authorIDs": ["a1"]}])
    q = jsonl.read_official_queries(spark, str(tmp_path / "x" / "data" / "*_input_queries.jsonl"))
    assert [(r["alias"], r["side"]) for r in q.collect()] == [("a1", "query")]
    _write(tmp_path / "x" / "data" / "s_input_queries.jsonl", [{"fullText": "q", "authorIDs": ["a2"]}])
    with pytest.raises(ValueError, match="exactly one"):
        jsonl.read_official_queries(spark, str(tmp_path / "x" / "data" / "*_input_queries.jsonl"))
    _write(tmp_path / "y" / "c_input_candidates.jsonl", [{"fullText": "c", "authorSetIDs": ["s1"]}])
    c = jsonl.read_official_candidates(spark, str(tmp_path / "y" / "*_input_candidates.jsonl"))
    assert [(r["alias"], r["side"]) for r in c.collect()] == [("s1", "candidate")]


def test_filtered_corpora_and_arrival_order(spark, tmp_path):
    for corpus in ("c1", "c2"):
        _write(tmp_path / corpus / "dev_queries_filtered.jsonl",
               [{"documentID": f"{corpus}q{i}", "fullText": str(i), "authorIDs": ["a"]} for i in range(3)])
        _write(tmp_path / corpus / "dev_candidates_filtered.jsonl",
               [{"documentID": f"{corpus}c{i}", "fullText": str(i), "authorIDs": ["a"]} for i in range(2)])
    df = jsonl.with_arrival_seq(jsonl.read_filtered_corpora(spark, str(tmp_path / "*" / "dev")))
    rows = df.orderBy("seq").collect()
    sides = [r["side"] for r in rows]
    assert sides == ["query"] * 6 + ["candidate"] * 4
    q_c1 = [r["documentID"] for r in rows if r["documentID"].startswith("c1q")]
    assert q_c1 == ["c1q0", "c1q1", "c1q2"]
    assert [r["seq"] for r in rows] == list(range(10))


def test_path_template():
    assert jsonl.expand_path("/d/{fold}/{split}/x", "f1", "dev") == "/d/f1/dev/x"


def test_npy_matrix_in_row_ranges(spark, tmp_path):
    m = np.arange(35, dtype=np.float64).reshape(7, 5) / 10
    p = tmp_path / "scores.npy"
    np.save(p, m)
    df = matrices.read_npy_matrix(spark, str(p), rows_per_task=3)
    got = {(r["query_id"], r["candidate_id"]): r["score"] for r in df.collect()}
    assert len(got) == 35 and got[(6, 4)] == pytest.approx(3.4)
    gt = matrices.read_npy_matrix(spark, str(p), value_name="label", as_int=True)
    assert dict(gt.schema.fields and [(f.name, f.dataType.simpleString()) for f in gt.schema.fields])["label"] == "bigint"


def test_unpivot_wide_rows(spark):
    wide = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.1, 0.9])], "query_id bigint, scores array<double>")
    long = matrices.unpivot_rows(wide)
    got = sorted(tuple(r) for r in long.collect())
    assert got == [(1, 0, 0.5), (1, 1, 0.25), (2, 0, 0.1), (2, 1, 0.9)]
    assert long.where(F.col("candidate_id") > 1).count() == 0


def test_arrival_order_across_file_splits(spark, tmp_path):
    """A file read in many splits keeps its line order in ``seq``."""
    rows = [{"documentID": f"d{i:04d}", "fullText": "x" * 50, "authorIDs": ["a"]} for i in range(400)]
    _write(tmp_path / "c" / "dev_queries_filtered.jsonl", rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        raw = jsonl.read_filtered_corpora(spark, str(tmp_path / "*" / "dev"))
        assert raw.rdd.getNumPartitions() > 5
        got = [r["documentID"] for r in jsonl.with_arrival_seq(raw).orderBy("seq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [f"d{i:04d}" for i in range(400)]


def test_raw_lines_round_trip_with_author(spark, tmp_path):
    from quire.sources import writers

    rows = [
        {"documentID": "d1", "fullText": "x", "authorIDs": ['a"b'], "other": [1, {"k": None}]},
        {"documentID": "d2", "fullText": "y", "authorIDs": [None]},
    ]
    _write(tmp_path / "in" / "dev_x.jsonl", rows)
    df = jsonl.read_corpus(spark, str(tmp_path / "in"), "dev", keep_raw=True).withColumn("output", F.lit("o"))
    writers.write_filtered_lines(df, str(tmp_path / "out"))
    back = [json.loads(line) for p in (tmp_path / "out").rglob("*.txt") for line in p.read_text().splitlines()]
    by = {r["documentID"]: r for r in back}
    assert by["d1"]["authorID"] == 'a"b' and by["d1"]["other"] == [1, {"k": None}]
    assert by["d2"]["authorID"] is None


def _numbered(spark, base, split_bytes):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        return jsonl.with_arrival_seq(jsonl.read_corpus(spark, str(base), "dev"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_arrival_order_over_many_file_splits_without_a_shuffle(spark, tmp_path):
    """Files of unlike sizes, cut into many splits that Spark packs largest
    first: positions are still file by file, line by line."""
    want = []
    for name, n in (("dev_a", 40), ("dev_b", 900), ("dev_c", 0), ("dev_d", 333)):
        rows = [{"documentID": f"{name}-{i}", "fullText": "word " * (i % 23), "authorIDs": ["x"]} for i in range(n)]
        _write(tmp_path / f"{name}.jsonl", rows)
        want += [r["documentID"] for r in rows]
    df = _numbered(spark, tmp_path, "4k")
    assert df.select("file").distinct().count() == 3
    assert [(r["seq"], r["documentID"]) for r in df.orderBy("seq").collect()] == list(enumerate(want))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    # the text side reaches the join without an exchange
    assert "rangepartitioning" not in plan and "hashpartitioning" not in plan


def test_arrival_order_when_rows_were_filtered_or_offsets_are_many(spark, tmp_path, monkeypatch):
    from quire.operators import indexing

    _write(tmp_path / "dev.jsonl", [{"documentID": str(i), "fullText": "t", "authorIDs": ["x"]} for i in range(50)])
    odd = jsonl.read_corpus(spark, str(tmp_path), "dev").where(F.col("documentID").cast("int") % 2 == 1)
    got = [(r["seq"], r["documentID"]) for r in jsonl.with_arrival_seq(odd).orderBy("seq").collect()]
    assert got == [(k, str(2 * k + 1)) for k in range(25)]
    monkeypatch.setattr(indexing, "BROADCAST_SPLITS", 0)
    joined = _numbered(spark, tmp_path, "1k")
    assert [r["documentID"] for r in joined.orderBy("seq").collect()] == [str(i) for i in range(50)]
    none = jsonl.with_arrival_seq(jsonl.read_corpus(spark, str(tmp_path), "dev").where(F.lit(False)))
    assert none.count() == 0
