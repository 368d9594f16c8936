"""Authors whose every document pair is below a threshold, without the pairs
of authors that are known to fail.

One pair at or above the threshold proves that an author is too similar, so
an author with n documents rarely needs all its n² pairs. Three steps, each on
what the one before left, and each judging pairs by the same kernel
(:func:`quire.operators.similarity.author_pairs`), so the answer is that of
comparing everything:

1. **One block.** Of every author with more than ``block_rows`` documents,
   about ``block_rows`` documents, chosen by a hash, are compared with each
   other. Only those rows are shuffled.
2. **Neighbours.** The documents of the authors left are ordered by (author,
   signature), the signature being the signs of fixed projections of the unit
   vector, and cut into blocks of ``block_rows`` neighbours; a block is
   compared with itself. Copies and near copies stand side by side, so one
   such pair among many unlike documents is found in n · block_rows
   comparisons. The order is a distributed index: an author with a third of
   all rows spans many ranges.
3. **All pairs** of the authors that have no proof against them, which also
   gives the exact maximum that the author info reports.

The steps only ever drop an author by a pair that was computed, never by an
estimate. Step 3 stays quadratic in the documents of an author without any
similar pair; that author's maximum is part of the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.vectors import np_normalize, np_stack
from quire.operators.indexing import dense_index
from quire.operators.similarity import author_pairs
from quire.session import ship_package, stable

SIGNATURE_BITS = 48
_SEED = 20_011


def with_signature(docs: DataFrame, vec: str = "vec", out: str = "_sig", featurize=None) -> DataFrame:
    """``out``: the signs of ``SIGNATURE_BITS`` fixed Gaussian projections as
    a BIGINT, first projection in the highest bit. Equal directions have equal
    signatures; a null or zero vector has every bit set."""
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())])

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(SIGNATURE_BITS - 1, -1, -1, dtype=np.int64)
        for pdf in batches:
            pdf = pdf.copy()
            values = pdf[vec].reset_index(drop=True)
            m = np_normalize(featurize(values) if featurize is not None else np_stack(values))
            width = m.shape[1] if m.ndim == 2 else 0
            if width not in planes:
                planes[width] = np.random.default_rng(_SEED).normal(size=(width, SIGNATURE_BITS))
            bits = (m.reshape(len(pdf), width) @ planes[width]) >= 0
            # a batch of null vectors only has width 0: all products are 0
            pdf[out] = bits.astype(np.int64) @ weights
            yield pdf

    ship_package(docs.sparkSession)
    return docs.mapInPandas(run, schema)


def authors_below(
    docs: DataFrame,
    threshold: float,
    author: str = "author_id",
    doc: str = "doc_id",
    order: tuple[str, ...] = ("seq", "doc_id"),
    vec: str = "vec",
    block_rows: int = 256,
    featurize=None,
    steps: list | None = None,
) -> DataFrame:
    """``(author, max_sim)`` of every author with more than one document whose
    largest pair similarity is strictly under ``threshold``.

    Equal to ``author_pairs(..., emit="max")`` filtered on ``max_sim``, ties
    and null vectors included. ``steps``, when given, receives
    ``(step, authors dropped)`` for the first two steps.
    """
    threshold = float(threshold)
    order = tuple(order)
    if docs.isStreaming:
        raise ValueError("a bounded table is expected")
    docs = docs.where(F.col(author).isNotNull()).select(*dict.fromkeys([author, doc, *order, vec]))

    def largest(rows: DataFrame, by: str) -> DataFrame:
        return author_pairs(rows, by, doc, order, vec, block_rows, emit="max", featurize=featurize)

    blocks = F.ceil(F.col("_n") / F.lit(float(block_rows))).cast("int")
    sizes = docs.groupBy(author).agg(F.count(F.lit(1)).alias("_n"))
    left = stable(sizes.where(F.col("_n") > block_rows).select(author, blocks.alias("_nb")))
    if left.isEmpty():  # every author is one block already
        return largest(docs, author).where(F.col("max_sim") < threshold)

    dropped: list[DataFrame] = []

    def drop(proven: DataFrame, name: str) -> None:
        nonlocal left
        proven = stable(proven.select(author).distinct())
        dropped.append(proven)
        left = left.join(proven, author, "left_anti")
        if steps is not None:
            steps.append((name, proven.count()))

    # 1. one block of each author; its own hash, so that the blocks which
    # author_pairs may cut from it are not all the same residue
    picked = docs.join(left, author).where(F.pmod(F.xxhash64(F.lit("one block"), F.col(doc)), F.col("_nb")) == 0)
    drop(largest(picked.drop("_nb"), author).where(F.col("max_sim") >= threshold), "one block")

    # 2. blocks of neighbours, never across authors
    if not left.isEmpty():
        signed = with_signature(docs.join(left.select(author), author, "left_semi"), vec, "_sig", featurize)
        placed = dense_index(signed, [author, "_sig", *order], out="_pos")
        number = F.floor(F.col("_pos") / F.lit(block_rows)).cast("bigint").cast("string")
        # the number ends at the first bar, so two authors never share a cell
        cells = placed.withColumn("_cell", F.concat_ws("|", number, F.col(author).cast("string")))
        alike = largest(cells, "_cell").where(F.col("max_sim") >= threshold).select("_cell")
        drop(cells.select(author, "_cell").distinct().join(alike, "_cell", "left_semi"), "neighbours")

    # 3. everything about the authors without a proof
    for proven in dropped:
        docs = docs.join(proven, author, "left_anti")
    return largest(docs, author).where(F.col("max_sim") < threshold)
