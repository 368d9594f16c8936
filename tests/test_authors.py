import json

import pytest
from pyspark.sql import functions as F

from quire.functions.idparse import parse_author_key
from quire.operators import authors
from quire.sources.idmap import read_id_map_object


def test_parse_both_dialects(spark):
    keys = [("(\"('a0',)\", 'HRS1.1')",), ("('a1', 'HRS2.0')",), ("not a tuple",), ("['a2', \"HRS1\"]",)]
    df = spark.createDataFrame(keys, "k string")
    got = df.select(
        "k", parse_author_key("k", "nested").alias("n"), parse_author_key("k", "mixed").alias("m")
    ).collect()
    by = {r["k"]: (r["n"], r["m"]) for r in got}
    assert by["(\"('a0',)\", 'HRS1.1')"] == ("a0", "a0")
    assert by["('a1', 'HRS2.0')"] == (None, "a1")  # plain key does not parse as nested
    assert by["not a tuple"] == (None, None)
    # a list whose second element starts with HRS1 but whose first is not nested
    assert by["['a2', \"HRS1\"]"] == (None, None)


def test_keys_of_any_length_with_escaped_quotes(spark):
    ids = ["o'neil", 'say "x"', "it's \"q\"", "back\\slash", "a, b)", "é"]
    nested = {repr((repr((i,)), "HRS1.1")): i for i in ids}
    nested |= {repr((repr((i, "b", "c")), "HRS1", "third")): i for i in ids}
    plain = {repr((i, "HRS2")): i for i in ids} | {repr((i, "HRS2", "x", "y")): i for i in ids} | {repr([i, "HRS2"]): i for i in ids}
    one = {repr((repr((i,)),)): i for i in ids} | {repr([repr((i,))]): i for i in ids}
    broken = ["('a'", "('a')", "(a, 'b')", "('a\\q', 'HRS2')", "()", ""]
    df = spark.createDataFrame([(k,) for k in [*nested, *plain, *one, *broken]], "k string")
    got = {r["k"]: (r["n"], r["m"]) for r in df.select("k", parse_author_key("k", "nested").alias("n"), parse_author_key("k", "mixed").alias("m")).collect()}
    assert {k: got[k] for k in nested} == {k: (i, i) for k, i in nested.items()}
    assert {k: got[k][1] for k in plain} == plain
    assert {k: got[k] for k in one} == {k: (i, None) for k, i in one.items()}
    assert all(got[k] == (None, None) for k in broken)


def test_last_entry_wins_and_conflict_counted(spark):
    rows = [("('k1', 'HRS2.0')", "v", 0), ("('k2', 'HRS2.0')", "v", 1)]
    m = authors.build_id_map(spark.createDataFrame(rows, "map_key string, map_value string, pos bigint"), "mixed")
    got = {r["alias"]: (r["author_id"], r["n_targets"]) for r in m.collect()}
    assert got["v"] == ("k2", 2)
    assert got["k1"] == ("k1", 1) and got["k2"] == ("k2", 1)


def test_json_object_map_keeps_file_order(spark, tmp_path):
    p = tmp_path / "author-set-ids-map.json"
    obj = {"('b', 'HRS2.0')": "x", "('a', 'HRS2.0')": "x"}
    p.write_text(json.dumps(obj))
    rows = read_id_map_object(spark, str(p)).orderBy("pos").collect()
    assert [r["map_key"] for r in rows] == list(obj)
    m = authors.build_id_map(read_id_map_object(spark, str(p)), "mixed")
    assert {r["alias"]: r["author_id"] for r in m.collect()}["x"] == "a"


def test_strict_resolution_raises(spark):
    m = spark.createDataFrame([("s1", "a1", 1)], "alias string, author_id string, n_targets bigint")
    docs = spark.createDataFrame([(1, "s1"), (2, "s9")], "doc_id bigint, alias string")
    with pytest.raises(Exception, match="unknown author alias"):
        authors.resolve_authors(docs, m, strict=True).collect()
    assert [r["doc_id"] for r in authors.unresolved_aliases(docs, m).collect()] == [2]
    assert authors.resolve_authors(docs, m, strict=False).count() == 1


def test_strict_unparsed_keys_raise(spark):
    rows = [("('a1', 'HRS2.0')", "s1", 0)]
    with pytest.raises(Exception, match="does not parse"):
        authors.build_id_map(spark.createDataFrame(rows, "map_key string, map_value string, pos bigint"), "nested").collect()


def test_prefix_split_head_and_tail_partition_ids(spark):
    ids = spark.createDataFrame([("query", f"a{i:02d}") for i in range(10)], "side string, author_id string")
    head = authors.prefix_split(ids, 0.8)
    tail = authors.prefix_split(ids, 0.2)
    h = sorted(r["author_id"] for r in head.where(F.col("selected") == 1).collect())
    t = sorted(r["author_id"] for r in tail.where(F.col("selected") == 1).collect())
    assert h == [f"a{i:02d}" for i in range(8)]
    assert t == ["a08", "a09"]
    assert not set(h) & set(t)


def test_document_count_thresholds(spark):
    rows = []
    for a, n in (("one", 1), ("two", 2), ("five", 5), ("six", 6)):
        rows += [(a, i, i, "t", "candidate") for i in range(n)]
    d = spark.createDataFrame(rows, "author_id string, doc_id bigint, seq bigint, full_text string, side string")
    s = authors.dataset_stats(d).first()
    assert s["n_authors"] == 4 and s["n_authors_labelled"] == 1 and s["n_labelled_rows"] == 6
