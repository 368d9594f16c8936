"""Keep authors none of whose document pairs look alike.

docs (author_id, doc_id, seq, vec) -> P3 (more than one document) -> authors
with a pair at the threshold dropped by one proven pair -> J3 pairs of the
others in bounded cells -> A2 max per author -> P6 ``max_sim < threshold``
(strict) -> R1 seeded cap -> J4 semi join back to the documents; A7 retention
report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.sampling import cap_ids
from quire.operators.similarity import author_pairs
from quire.operators.witness import authors_below
from quire.session import stable


def author_pair_similarity(
    docs: DataFrame, author: str = "author_id", block_rows: int = 256, featurize=None
) -> DataFrame:
    """A3 in long form: ``(author, doc_i, doc_j, sim)``; repeated document ids
    are kept as separate pairs (no collapse)."""
    return author_pairs(docs, author=author, block_rows=block_rows, emit="pairs", featurize=featurize)


def author_max_similarity(
    docs: DataFrame, author: str = "author_id", block_rows: int = 256, featurize=None
) -> DataFrame:
    """A2: ``(author, max_sim)`` for every author with more than one document."""
    return author_pairs(docs, author=author, block_rows=block_rows, emit="max", featurize=featurize)


def diverse_authors(
    docs: DataFrame,
    threshold: float = 0.2,
    cap: int | None = None,
    seed: int = 0,
    author: str = "author_id",
    block_rows: int = 256,
    featurize=None,
) -> tuple[DataFrame, DataFrame]:
    """Returns ``(info, keep)``: the max similarity of every author under the
    threshold (before the cap, as the reference's info file), and the kept
    author ids after the cap."""
    info = authors_below(docs, threshold, author, block_rows=block_rows, featurize=featurize)
    info = stable(info)  # one row per author; read by the cap and by the caller
    keep = cap_ids(info.select(author), cap, seed, id_col=author)
    return info, keep


def filter_diverse_authors(docs: DataFrame, keep: DataFrame, author: str = "author_id") -> DataFrame:
    """Documents of kept authors, all columns kept."""
    return docs.join(keep.select(author), author, "left_semi")


def retention_report(docs: DataFrame, keep: DataFrame, by: str, author: str = "author_id") -> DataFrame:
    """Per ``by`` value (a file, a side), rows before and after."""
    flagged = docs.select(by, author).join(keep.select(author).withColumn("_kept", F.lit(1)), author, "left")
    return flagged.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows_before"), F.count("_kept").alias("rows_after")
    )
