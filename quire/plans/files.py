"""User-level pipelines that start from the reference's files.

These compose the sources, operators and plans the way the reference's
notebook and trainer functions do, but end in DataFrames and Parquet/JSON
folders instead of in-memory lists:

* :func:`author_filter_from_jsonl` — C1 (``extract_split_similarity_info``)
* :func:`pairs_from_official` — C2 / C3 (both id dialects and layouts)
* :func:`labelled_from_official` — C4
* :func:`first_two_from_filtered` — C5
* :func:`evaluate_from_npy` — C7 on saved score / truth matrices
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as TX
from quire.operators import authors as A
from quire.operators.metrics import attach_truth, macro_metrics, per_query_metrics
from quire.plans import diversity, pairs
from quire.session import stable
from quire.sources import idmap, jsonl, matrices, writers


@dataclass
class FilterResult:
    kept_docs: DataFrame  # surviving documents, all read columns + authorID (K1)
    info: DataFrame  # author_id, max_sim for every author under the threshold (K2)
    keep: DataFrame  # kept author ids after the cap (R1)
    report: DataFrame  # rows before / after per file (A7)


def author_filter_from_jsonl(
    spark: SparkSession,
    directory: str,
    split: str,
    out_dir: str | None = None,
    threshold: float = 0.2,
    cap: int | None = None,
    seed: int = 0,
    encoder_factory=None,
    dim: int = TX.DEFAULT_DIM,
    block_rows: int = 256,
    hash_fn: str = "md5",
) -> FilterResult:
    """Read ``{split}*.jsonl`` (not ``*filtered*``), embed each document
    once, keep authors whose every document pair is below ``threshold``,
    cap them, and write the filtered files and the author info."""
    docs = jsonl.with_arrival_seq(jsonl.read_corpus(spark, directory, split, keep_raw=True))
    docs = docs.withColumn("author_id", F.col("authorID")).withColumn("doc_id", F.col("seq"))
    if encoder_factory is None:
        vecs = TX.embed_documents(
            docs.select("author_id", "doc_id", "seq", "fullText"), text="fullText", dim=dim, out="vec", hash_fn=hash_fn
        )
        featurize = partial(TX.bucket_matrix, dim=dim)
    else:
        vecs = TX.encode_with(docs.select("author_id", "doc_id", "seq", "fullText"), encoder_factory, text="fullText")
        featurize = None
    vecs = stable(vecs)  # the encoder is the dearest step: its result is read four times
    info, keep = diversity.diverse_authors(vecs, threshold, cap, seed, block_rows=block_rows, featurize=featurize)
    kept = diversity.filter_diverse_authors(docs, keep).drop("author_id", "doc_id")
    report = diversity.retention_report(docs, keep, by="file")
    if out_dir:
        # K1: every original field of each kept line, plus authorID
        name = F.regexp_replace(jsonl.source_name("file"), r"\.jsonl$", "_filtered")
        writers.write_filtered_lines(kept.withColumn("output", name), f"{out_dir}/{split}", by=("output",))
        passed = vecs.join(info.select("author_id"), "author_id", "left_semi")
        pair_sims = diversity.author_pair_similarity(passed, block_rows=block_rows, featurize=featurize)
        writers.write_author_info(info, pair_sims, f"{out_dir}/{split}_info")
    return FilterResult(kept.drop("_raw"), info, keep, report)


def _official_docs(spark: SparkSession, root: str, layout: str) -> DataFrame:
    sub = jsonl.OFFICIAL_DATA_DIR[layout]
    q = jsonl.read_official_queries(spark, f"{root}/{sub}/{jsonl.OFFICIAL_QUERIES}")
    c = jsonl.read_official_candidates(spark, f"{root}/{sub}/{jsonl.OFFICIAL_CANDIDATES}")
    cols = ["fullText", "alias", "side", "file", "_block", "_row"]
    docs = jsonl.with_arrival_seq(q.select(*cols).unionByName(c.select(*cols)))
    return docs.select(F.col("seq").alias("doc_id"), "seq", "side", "alias", F.col("fullText").alias("full_text"))


def _official_map(spark: SparkSession, root: str, dialect: str) -> DataFrame:
    return A.build_id_map(idmap.read_id_map_ranges(spark, f"{root}/{jsonl.ID_MAP_FILE}"), dialect)


def pairs_from_official(
    spark: SparkSession,
    path_template: str,
    fold: str,
    split: str,
    epoch: int,
    dialect: str = "nested",
    layout: str = "A",
    split_percent: float | None = None,
    strict: bool = True,
    batch_size: int = 64,
) -> DataFrame:
    """C2 (``dialect='nested'``, layout A) and C3 (``dialect='mixed'``,
    layout B), see :data:`quire.sources.jsonl.OFFICIAL_DATA_DIR`: one epoch of
    ``(anchors, positives)`` rows in their shuffled order."""
    root = jsonl.expand_path(path_template, fold, split)
    docs = A.resolve_authors(_official_docs(spark, root, layout), _official_map(spark, root, dialect), strict=strict)
    ps = pairs.build_cross_role_pairs(docs, split, epoch, split_percent, strict=strict, batch_size=batch_size)
    return pairs.attach_texts(ps.rows, docs, ("row_id",))


def labelled_from_official(
    spark: SparkSession, path_template: str, fold: str, split: str, dialect: str = "nested", layout: str = "A", min_docs: int = 5
) -> DataFrame:
    """C4: labelled rows ``(anchors, others, labels)`` in writer order."""
    root = jsonl.expand_path(path_template, fold, split)
    docs = A.resolve_authors(_official_docs(spark, root, layout), _official_map(spark, root, dialect))
    expanded = A.expand_id_map(idmap.read_id_map_ranges(spark, f"{root}/{jsonl.ID_MAP_FILE}"), dialect)
    return pairs.build_labelled_rows(docs, expanded, min_docs)


def first_two_from_filtered(spark: SparkSession, prefix_template: str, split: str, epoch: int) -> DataFrame:
    """First two documents per author over all filtered corpora."""
    raw = jsonl.read_filtered_corpora(spark, jsonl.expand_path(prefix_template, split=split))
    docs = jsonl.with_arrival_seq(raw).select(
        "author_id", F.col("seq").alias("doc_id"), "seq", "side", F.col("fullText").alias("full_text")
    )
    return pairs.build_first_two_pairs(docs, split, epoch)


def evaluate_from_npy(spark: SparkSession, scores_path: str, truth_path: str) -> tuple[DataFrame, DataFrame]:
    """C7 on the saved matrices: per-query EER/AP and the macro means."""
    scores = matrices.read_npy_matrix(spark, scores_path, "score")
    truth = matrices.read_npy_matrix(spark, truth_path, "label", as_int=True)
    pq = per_query_metrics(attach_truth(scores, truth))
    return pq, macro_metrics(pq)
