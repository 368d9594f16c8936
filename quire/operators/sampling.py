"""Seeded sampling that does not depend on partitioning.

All draws are ranks of :func:`quire.functions.hashing.hash_key` values, so a
result is a pure function of the data and ``(seed, tag)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.hashing import hash_key
from quire.operators.indexing import dense_index


def epoch_seed(split: str, epoch: int) -> int:
    """The epoch seeds the train split; every other split uses 0."""
    return int(epoch) if split == "train" else 0


def cap_ids(ids: DataFrame, cap: int | None, seed: int, id_col: str = "author_id", tag: str = "cap") -> DataFrame:
    """At most ``cap`` ids, uniform without replacement, seeded.

    Ranks by ``hash_key(seed, tag, id)`` with a distributed dense index, so
    neither the ids nor the top ``cap`` pass through one task.
    """
    if cap is None:
        return ids
    ranked = dense_index(ids.withColumn("_h", hash_key(seed, tag, id_col)), ["_h", id_col], out="_r")
    return ranked.where(F.col("_r") < int(cap)).drop("_h", "_r")


def pick_hash(seed: int, tag_col: str | None, doc: str = "doc_id"):
    """The R2 draw key of a row: ``hash_int(seed, <tag column>, doc)``."""
    tag = F.col(tag_col) if tag_col else F.lit("one")
    key = F.md5(F.concat_ws("|", F.lit(str(int(seed))), tag, F.col(doc).cast("string")))
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("bigint")


def pick_one(
    docs: DataFrame, group: list[str], seed: int, tag_col: str | None, doc: str = "doc_id", out: str = "pick"
) -> DataFrame:
    """R2: one uniformly chosen ``doc`` per group: the smallest
    :func:`pick_hash`. ``min_by`` aggregates partially before the shuffle,
    so a hot group costs no more than any other."""
    return docs.groupBy(*group).agg(F.min_by(F.col(doc), pick_hash(seed, tag_col, doc)).alias(out))


def shuffle_key(seed: int, row_id) -> "F.Column":
    """Sort key of the seeded epoch shuffle."""
    return hash_key(seed, "shuffle", row_id)
