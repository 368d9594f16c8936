import os

import pytest
from pyspark.sql import functions as F

from quire.sources import jsonl, writers
from quire.streaming.epochs import write_epochs
from tests.test_sources import _write


def _rows(spark, n, tag="a"):
    return spark.range(n).select((F.lit(n - 1) - F.col("id")).alias("row_pos"), F.lit(tag).alias("tag"))


def _left(path):
    return os.listdir(os.path.join(path, "_staging"))


def test_short_epoch_fails_and_earlier_epochs_stay(spark, tmp_path):
    path = str(tmp_path)
    sizes = {0: 30, 1: 30, 2: 29}
    with pytest.raises(writers.RowCountMismatch, match="29 rows, expected 30"):
        write_epochs(lambda e: (_rows(spark, sizes[e]), 30), [0, 1, 2], path)
    assert writers.committed(spark, path) == ["epoch=0", "epoch=1"]
    got = writers.read_committed(spark, path).groupBy("epoch").count().orderBy("epoch").collect()
    assert [tuple(r) for r in got] == [(0, 30), (1, 30)]
    assert _left(path) == [] and not os.path.exists(os.path.join(path, "epoch=2"))


def test_failed_rewrite_keeps_the_old_epoch_and_a_good_one_replaces_it(spark, tmp_path):
    path = str(tmp_path)
    assert writers.write_epoch_rows(_rows(spark, 5, "old"), path, 3, expected=5) == 5
    with pytest.raises(writers.RowCountMismatch):
        writers.write_epoch_rows(_rows(spark, 4, "new"), path, 3, expected=5)
    assert {r["tag"] for r in writers.read_committed(spark, path).collect()} == {"old"}
    broken = _rows(spark, 5, "new").withColumn("bad", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        writers.write_epoch_rows(broken, path, 3, expected=5)
    assert {r["tag"] for r in writers.read_committed(spark, path).collect()} == {"old"}
    writers.write_epoch_rows(_rows(spark, 6, "new"), path, 3)
    assert [r["tag"] for r in writers.read_committed(spark, path).collect()] == ["new"] * 6
    assert _left(path) == []
    with open(os.path.join(path, "_committed", "epoch=3")) as f:
        assert f.read() == "6"


def test_a_folder_without_its_marker_is_not_read(spark, tmp_path):
    path = str(tmp_path)
    writers.write_epoch_rows(_rows(spark, 3), path, 0)
    writers.write_epoch_rows(_rows(spark, 4), path, 1)
    os.remove(os.path.join(path, "_committed", "epoch=1"))  # as if the job had died before the marker
    assert writers.read_committed(spark, path).count() == 3
    with pytest.raises(FileNotFoundError):
        writers.read_committed(spark, str(tmp_path / "nothing"))


def test_empty_write_counts_zero(spark, tmp_path):
    assert writers.write_epoch_rows(_rows(spark, 0), str(tmp_path), 0, expected=0) == 0
    assert writers.read_committed(spark, str(tmp_path)).count() == 0


def test_corpus_of_folders_and_single_files(spark, tmp_path):
    _write(tmp_path / "dev_a.jsonl", [{"documentID": "1", "fullText": "x", "authorIDs": ["a"]}])
    _write(tmp_path / "dev_b.jsonl" / "part-0.json", [{"documentID": "2", "fullText": "y", "authorIDs": ["b"]}])
    _write(tmp_path / "dev_b.jsonl" / "part-1.json", [{"documentID": "3", "fullText": "z", "authorIDs": ["c"]}])
    _write(tmp_path / "dev_b_filtered.jsonl" / "part-0.json", [{"documentID": "old", "fullText": "", "authorIDs": []}])
    for raw in (False, True):
        df = jsonl.with_arrival_seq(jsonl.read_corpus(spark, str(tmp_path), "dev", keep_raw=raw))
        got = df.orderBy("seq").select("seq", "documentID", jsonl.source_name("file").alias("n")).collect()
        assert [tuple(r) for r in got] == [(0, "1", "dev_a.jsonl"), (1, "2", "dev_b.jsonl"), (2, "3", "dev_b.jsonl")]
        none = jsonl.read_corpus(spark, str(tmp_path), "train", keep_raw=raw)
        assert none.count() == 0 and none.columns == jsonl.read_corpus(spark, str(tmp_path), "dev", keep_raw=raw).columns


def test_official_file_may_be_one_folder(spark, tmp_path):
    _write(tmp_path / "r_input_queries.jsonl" / "part-0.json", [{"fullText": "q", "authorIDs": ["a1"]}])
    _write(tmp_path / "r_input_queries.jsonl" / "part-1.json", [{"fullText": "q", "authorIDs": ["a2"]}])
    pattern = str(tmp_path / jsonl.OFFICIAL_QUERIES)
    assert sorted(r["alias"] for r in jsonl.read_official_queries(spark, pattern).collect()) == ["a1", "a2"]
    _write(tmp_path / "s_input_queries.jsonl" / "part-0.json", [{"fullText": "q", "authorIDs": ["a3"]}])
    with pytest.raises(ValueError, match="exactly one"):
        jsonl.read_official_queries(spark, pattern)
