import json

import pytest

from quire.sources.idmap import read_id_map_ranges, write_id_map_object


def _read(spark, path):
    return [(r["map_key"], r["map_value"]) for r in read_id_map_ranges(spark, str(path)).orderBy("pos").collect()]


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


ODD = {
    "plain": "x",
    'a "quoted" key': 'ends in a quote"',
    "backslash \\": "\\\\ two, then \\",
    '\\"': '\\\\"',
    "": "",
    "braces { } , : [ ]": '{"k": "v"}',
    "line\nbreak\ttab\r": "é ü 漢字 \U0001f600",
    "long": "ab\"\\" * 300,
}


def test_equal_to_json_load_over_many_ranges(spark, tmp_path, small_ranges):
    for n, style in enumerate(({}, {"indent": 2}, {"ensure_ascii": False, "separators": (",", ":")})):
        p = tmp_path / f"map{n}.json"
        p.write_text(json.dumps(ODD, **style), encoding="utf-8")
        assert spark.read.option("lineSep", '"').text(str(p)).rdd.getNumPartitions() > 10
        assert _read(spark, p) == list(ODD.items())


def test_a_repeated_key_keeps_its_place_and_its_last_value(spark, tmp_path, small_ranges):
    p = tmp_path / "map.json"
    p.write_text('{ "a" : "1", "b": "2",\n "\\u0061": "3", "c": "4", "b": "5" }\n')
    assert _read(spark, p) == list(json.loads(p.read_text()).items()) == [("a", "3"), ("b", "5"), ("c", "4")]


@pytest.mark.parametrize("text", [" { \n } ", "{}", ""])
def test_empty_objects(spark, tmp_path, text):
    p = tmp_path / "map.json"
    p.write_text(text)
    assert _read(spark, p) == []


@pytest.mark.parametrize(
    "text",
    ['{"a": "b"', '{"a": "b",}', '{"a": 1}', '{"a": null, "b": "c"}', '["a", "b"]', '{"a": "b"} {"c": "d"}',
     '{"a": "b"}, "c": "d"}', '{"a" "b"}', '{"a": {"b": "c"}}', '{"a": "b" "c": "d"}', '{"a": "b', '{} "a": "b"}'],
)
def test_what_is_no_object_of_strings_raises(spark, tmp_path, text):
    p = tmp_path / "map.json"
    p.write_text(text)
    with pytest.raises(ValueError, match="not a JSON object of strings"):
        read_id_map_ranges(spark, str(p))


def test_written_parts_are_objects_and_read_back(spark, tmp_path):
    rows = [(k, v, i) for i, (k, v) in enumerate(ODD.items())]
    entries = spark.createDataFrame(rows, "map_key string, map_value string, pos bigint")
    write_id_map_object(entries, str(tmp_path / "out"))
    for part in (tmp_path / "out").glob("part-*"):
        assert isinstance(json.loads(part.read_text(encoding="utf-8")), dict)
    assert _read(spark, tmp_path / "out") == list(ODD.items())
