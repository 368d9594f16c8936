"""Author identity and author-level statistics.

S6/F6 expand the author-id map, J1 resolves document aliases through it,
A4-A6 count authors and documents per role, W1 numbers every id of the map,
R6 splits the sorted author ids by a prefix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.idparse import parse_author_key
from quire.operators.indexing import dense_index, grouped_running_sums


def expand_id_map(id_map: DataFrame, dialect: str = "nested") -> DataFrame:
    """Map rows ``(map_key, map_value, pos)`` -> ``(alias, author_id, _ord)``.

    For each entry the canonical id ``k`` maps to itself and the value maps
    to ``k``. ``_ord`` keeps file order (key before value) for last-wins.
    """
    k = parse_author_key("map_key", dialect)
    base = id_map.select(k.alias("_k"), F.col("map_value").alias("_v"), F.col("pos").cast("bigint").alias("_pos"))
    self_rows = base.select(F.col("_k").alias("alias"), F.col("_k").alias("author_id"), (F.col("_pos") * 2).alias("_ord"))
    value_rows = base.select(
        F.col("_v").alias("alias"), F.col("_k").alias("author_id"), (F.col("_pos") * 2 + 1).alias("_ord")
    )
    return self_rows.unionByName(value_rows)


def id_map_unparsed(id_map: DataFrame, dialect: str = "nested") -> DataFrame:
    """Entries whose key does not parse in ``dialect``."""
    return id_map.where(parse_author_key("map_key", dialect).isNull())


def resolve_map(expanded: DataFrame) -> DataFrame:
    """Last entry wins per alias (``max_by`` on file order, partial aggregate);
    ``n_targets`` > 1 marks a conflicting alias."""
    e = expanded.where(F.col("alias").isNotNull() & F.col("author_id").isNotNull())
    return e.groupBy("alias").agg(
        F.max_by("author_id", "_ord").alias("author_id"),
        F.count_distinct("author_id").alias("n_targets"),
    )


def build_id_map(id_map: DataFrame, dialect: str = "nested", strict: bool = True) -> DataFrame:
    """S6 + F6: ``(alias, author_id, n_targets)``. ``strict`` fails on keys
    that do not parse, as the reference's ``literal_eval`` would; the check
    is a ``raise_error`` inside the plan, so it costs no extra job."""
    if strict:
        k = parse_author_key("map_key", dialect)
        msg = F.concat(F.lit(f"id-map key does not parse ({dialect}): "), F.col("map_key"))
        id_map = id_map.where(F.when(k.isNull(), F.raise_error(msg)).otherwise(F.lit(True)))
    return resolve_map(expand_id_map(id_map, dialect))


def resolve_authors(docs: DataFrame, id_map: DataFrame, alias: str = "alias", strict: bool = True) -> DataFrame:
    """Add ``author_id`` from the alias. Strict mode fails when an alias is
    unknown (the reference raised KeyError) through a ``raise_error`` in the
    plan; otherwise unknown aliases are dropped here and listed by
    :func:`unresolved_aliases`. The join is planned by Spark: AQE turns it
    into a broadcast only when the measured map side is small."""
    m = id_map.select(F.col("alias").alias(alias), "author_id")
    if not strict:
        return docs.join(m, alias, "inner")
    joined = docs.join(m, alias, "left")
    msg = F.concat(F.lit("unknown author alias: "), F.col(alias))
    return joined.where(F.when(F.col("author_id").isNull(), F.raise_error(msg)).otherwise(F.lit(True)))


def unresolved_aliases(docs: DataFrame, id_map: DataFrame, alias: str = "alias") -> DataFrame:
    return docs.join(id_map.select(F.col("alias").alias(alias)), alias, "left_anti")


def role_counts(docs: DataFrame, author: str = "author_id", side: str = "side") -> DataFrame:
    """A4: documents per author per role and in total."""
    return docs.groupBy(author).agg(
        F.count_if(F.col(side) == "query").cast("bigint").alias("n_query"),
        F.count_if(F.col(side) == "candidate").cast("bigint").alias("n_candidate"),
        F.count(F.lit(1)).alias("n_docs"),
    )


def dataset_stats(docs: DataFrame, min_docs: int = 5, author: str = "author_id", side: str = "side") -> DataFrame:
    """A5/A6/A8 in one pass over the per-author counts."""
    rc = role_counts(docs, author, side)
    return rc.agg(
        F.count_if(F.col("n_query") > 0).cast("bigint").alias("n_query_authors"),
        F.count_if(F.col("n_candidate") > 0).cast("bigint").alias("n_candidate_authors"),
        F.count(F.lit(1)).alias("n_authors"),
        F.sum("n_docs").cast("bigint").alias("n_docs"),
        F.count_if(F.col("n_docs") > min_docs).cast("bigint").alias("n_authors_labelled"),
        F.coalesce(F.sum(F.when(F.col("n_docs") > min_docs, F.col("n_docs"))), F.lit(0))
        .cast("bigint")
        .alias("n_labelled_rows"),
        F.count_if((F.col("n_query") > 0) & (F.col("n_candidate") == 0)).cast("bigint").alias("n_query_only"),
    )


def label_ids(expanded: DataFrame) -> DataFrame:
    """``(id, label)`` = 0-based position of each id in the sorted set of
    all keys and values of the map (aliases use up numbers too)."""
    ids = (
        expanded.select(F.col("alias").alias("id"))
        .unionByName(expanded.select(F.col("author_id").alias("id")))
        .where(F.col("id").isNotNull())
        .distinct()
    )
    return dense_index(ids, ["id"], out="label")


def prefix_split(author_sides: DataFrame, split_percent: float, author: str = "author_id", side: str = "side") -> DataFrame:
    """Per role, sort the distinct author ids and cut at
    ``int(n * max(p, 1 - p))``; ``part`` is head or tail and ``selected`` marks
    the part the reference keeps (head when ``p`` is the bigger share)."""
    keep_head = split_percent >= 0.5
    share = split_percent if keep_head else 1 - split_percent
    ids = author_sides.select(side, author).distinct()
    pos = grouped_running_sums(ids.withColumn("_one", F.lit(1)), [side], [author], ["_one"], pos_col="pos")
    n = ids.groupBy(side).agg(F.count(F.lit(1)).alias("_n"))
    cut = F.floor(F.col("_n") * F.lit(float(share))).cast("bigint")
    out = pos.join(n, side).select(
        side, author, "pos", F.when(F.col("pos") < cut, "head").otherwise("tail").alias("part")
    )
    sel = F.col("part") == ("head" if keep_head else "tail")
    return out.withColumn("selected", sel.cast("int"))
