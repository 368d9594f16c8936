"""End-to-end pipelines from files, built from the driver's sf0.001 tables."""

import json

import numpy as np
import pytest

import __spark_entry__ as E
from quire.plans import files
from quire.sources import fixtures as fx
from tests.conftest import SF0001


def _jsonl(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_author_filter_from_jsonl_matches_registered_query(spark, tmp_path):
    docs = fx.table(spark, SF0001, "documents").select("doc_id", "text", "source").orderBy("doc_id").collect()
    rows = [
        {"documentID": str(d["doc_id"]), "fullText": d["text"], "authorIDs": [d["source"]], "meta": {"n": i, "tags": ["x"]}}
        for i, d in enumerate(docs)
    ]
    _jsonl(tmp_path / "corpus" / "dev_queries.jsonl", rows[0::2])
    _jsonl(tmp_path / "corpus" / "dev_candidates.jsonl", rows[1::2])
    _jsonl(tmp_path / "corpus" / "dev_queries_filtered.jsonl", rows[:3])  # an earlier output: ignored
    res = files.author_filter_from_jsonl(spark, str(tmp_path / "corpus"), "dev", out_dir=str(tmp_path / "out"), threshold=1.01)
    got = {r["author_id"]: round(r["max_sim"], 6) for r in res.info.collect()}
    want = {r["author_id"]: r["max_sim"] for r in E.queries()["diverse_authors_from_text"](spark, SF0001).collect()}
    assert got == want
    assert res.kept_docs.count() == len(rows)
    rep = {r["file"].rsplit("/", 1)[-1]: (r["rows_before"], r["rows_after"]) for r in res.report.collect()}
    assert rep == {"dev_queries.jsonl": (100, 100), "dev_candidates.jsonl": (100, 100)}
    back = spark.read.json(str(tmp_path / "out" / "dev"))
    assert back.count() == len(rows) and "authorID" in back.columns
    assert "meta" in back.columns  # fields the reader did not declare are kept (K1)
    one = back.where("documentID = '" + rows[5]["documentID"] + "'").first()
    assert one["meta"]["n"] == 5 and one["authorID"] == rows[5]["authorIDs"][0]
    assert spark.read.parquet(str(tmp_path / "out" / "dev_info" / "authors")).count() == len(want)


def _official(spark, root, layout_sub):
    d = fx.fx_aliased_docs(spark, SF0001).orderBy("side", "seq", "doc_id").collect()
    q = [{"documentID": str(r["doc_id"]), "fullText": r["full_text"], "authorIDs": [r["alias"]]} for r in d if r["side"] == "query"]
    c = [{"documentID": str(r["doc_id"]), "fullText": r["full_text"], "authorSetIDs": [r["alias"]]} for r in d if r["side"] == "candidate"]
    _jsonl(root / layout_sub / "x_input_queries.jsonl", q)
    _jsonl(root / layout_sub / "x_input_candidates.jsonl", c)
    m = fx.fx_id_map(spark, SF0001).orderBy("pos").collect()
    (root / "author-set-ids-map.json").write_text(json.dumps({r["map_key"]: r["map_value"] for r in m}))
    return len(q), len(c)


def test_pairs_from_official_layout_b(spark, tmp_path):
    _official(spark, tmp_path / "f0" / "train", "data")
    template = str(tmp_path / "{fold}" / "{split}")
    out = files.pairs_from_official(spark, template, "f0", "train", 2, dialect="mixed", layout="B", strict=False)
    rows = out.collect()
    stats = E.queries()["dataset_stats"](spark, SF0001).first()
    n_q, n_miss = stats["n_query_authors"], stats["n_query_only"]
    assert len(rows) == 2 * n_q - n_miss
    assert all(r["anchors"] and r["positives"] is not None for r in rows)
    again = files.pairs_from_official(spark, template, "f0", "train", 2, dialect="mixed", layout="B", strict=False)
    assert sorted(tuple(r) for r in again.collect()) == sorted(tuple(r) for r in rows)
    with pytest.raises(Exception, match="does not parse"):
        files.pairs_from_official(spark, template, "f0", "train", 2, dialect="nested", layout="B", strict=True).collect()


def test_labelled_from_official_matches_registered_query(spark, tmp_path):
    _official(spark, tmp_path / "f0" / "dev" , "TA2/hrs_01/data")
    out = files.labelled_from_official(spark, str(tmp_path / "{fold}" / "{split}"), "f0", "dev", dialect="mixed", layout="A")
    got = sorted((r["anchors"], r["labels"]) for r in out.collect())
    want = sorted((r["anchors"], r["labels"]) for r in E.queries()["labelled_rows"](spark, SF0001).collect())
    assert got == want


def test_first_two_from_filtered_matches_registered_query(spark, tmp_path):
    d = fx.fx_docs(spark, SF0001).orderBy("seq", "doc_id").collect()
    for corpus, parity in (("c1", 0), ("c2", 1)):
        for side, role in (("queries", "query"), ("candidates", "candidate")):
            rows = [
                {"documentID": str(r["doc_id"]), "fullText": r["full_text"], "authorIDs": [r["author_id"]]}
                for r in d
                if int(r["author_id"]) % 2 == parity and r["side"] == role
            ]
            _jsonl(tmp_path / corpus / f"dev_{side}_filtered.jsonl", rows)
    out = files.first_two_from_filtered(spark, str(tmp_path / "*" / "{split}"), "dev", 0)
    got = sorted((r["author_id"], r["anchors"], r["positives"]) for r in out.collect())
    want = [
        (r["author_id"], r["anchors"], r["positives"])
        for r in E.queries()["first_two_pairs"](spark, SF0001).collect()
    ]
    assert got == sorted(want)


def test_evaluate_from_npy_matches_registered_query(spark, tmp_path):
    s = E.queries()["score_query_candidates"](spark, SF0001).orderBy("query_id", "candidate_id").collect()
    qs = sorted({r["query_id"] for r in s})
    cs = sorted({r["candidate_id"] for r in s})
    qi, ci = {q: i for i, q in enumerate(qs)}, {c: i for i, c in enumerate(cs)}
    sm, tm = np.zeros((len(qs), len(cs))), np.zeros((len(qs), len(cs)))
    for r in s:
        sm[qi[r["query_id"]], ci[r["candidate_id"]]] = r["score"]
        tm[qi[r["query_id"]], ci[r["candidate_id"]]] = r["label"]
    np.save(tmp_path / "s.npy", sm)
    np.save(tmp_path / "t.npy", tm)
    _, macro = files.evaluate_from_npy(spark, str(tmp_path / "s.npy"), str(tmp_path / "t.npy"))
    got = macro.first()
    want = E.queries()["evaluate_macro"](spark, SF0001).first()
    assert got["n_queries"] == want["n_queries"]
    assert got["mean_eer"] == pytest.approx(want["mean_eer"], abs=2e-6)
    assert got["mean_ap"] == pytest.approx(want["mean_ap"], abs=2e-6)


def test_filter_output_feeds_first_two(spark, tmp_path):
    """C1 writes folders that C5 reads; a wrong path and a broken line fail."""
    import json

    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    for role, texts in (("queries", ["red stone", "blue field"]), ("candidates", ["green cloud", "old bird"])):
        rows = [{"documentID": f"{role}{a}{i}", "fullText": f"{t} {a}{role}", "authorIDs": [a]} for a in ("x", "y") for i, t in enumerate(texts)]
        (src / f"train_{role}.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
    files.author_filter_from_jsonl(spark, str(src), "train", out_dir=str(out), threshold=0.9)
    rows = files.first_two_from_filtered(spark, f"{out}/{{split}}", "train", epoch=0)
    got = rows.collect() if hasattr(rows, "collect") else rows.rows.collect()
    assert len(got) == 2
    with pytest.raises(FileNotFoundError):
        files.first_two_from_filtered(spark, f"{out}/nothing/{{split}}", "train", epoch=0)
    with open(src / "train_queries.jsonl", "a") as f:
        f.write('{"documentID": "z", "fullText": "cut o')
    with pytest.raises(Exception):  # noqa: B017
        files.author_filter_from_jsonl(spark, str(src), "train", threshold=0.9).report.collect()
