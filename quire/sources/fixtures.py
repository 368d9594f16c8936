"""Stand-in inputs derived from the driver's tables (see FIXTURES.md part 2).

Each function reads the given parquet tables, so every query that uses them
grows with the data. Only the columns each fixture needs are selected, so the
parquet scans prune columns and push filters down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fx_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author documents with roles: author_id, doc_id, seq, full_text, side."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").cast("string").alias("author_id"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"),
        F.col("turn").alias("seq"),
        F.col("text").alias("full_text"),
        F.when((F.col("role") == "user") & (F.col("conv_id") % 2 == 0), "query")
        .otherwise("candidate")
        .alias("side"),
    )


def fx_aliased_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_docs as the official files carry them: an alias instead of the
    author id ('a<id>' on queries, 's<id>' on candidates)."""
    d = fx_docs(spark, sf_dir)
    alias = F.when(F.col("side") == "query", F.concat(F.lit("a"), "author_id")).otherwise(
        F.concat(F.lit("s"), "author_id")
    )
    return d.select("doc_id", "seq", "full_text", "side", alias.alias("alias"))


def fx_id_map(spark: SparkSession, sf_dir: str, drop_mod10: int | None = None) -> DataFrame:
    """Author-id map rows: map_key (tuple text), map_value (alias), pos (file order)."""
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    if drop_mod10 is not None:
        c = c.where(F.col("conv_id") % 10 != drop_mod10)
    cid = F.col("conv_id").cast("string")
    nested = F.concat(F.lit("(\"('a"), cid, F.lit("',)\", 'HRS1.1')"))
    plain = F.concat(F.lit("('a"), cid, F.lit("', 'HRS2.0')"))
    return c.select(
        F.when(F.col("conv_id") % 3 == 0, nested).otherwise(plain).alias("map_key"),
        F.concat(F.lit("s"), cid).alias("map_value"),
        F.col("conv_id").alias("pos"),
    )


def fx_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with vectors, four per author: author_id, doc_id, seq, label, vec."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.floor(F.col("vec_id") / 4.0).cast("bigint").alias("author_id"),
        F.col("vec_id").alias("doc_id"),
        F.col("vec_id").alias("seq"),
        F.col("label"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


def fx_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fx_vectors(spark, sf_dir).where(F.col("doc_id") % 10 == 0)
    return v.select(F.col("doc_id").alias("query_id"), "label", "vec")


def fx_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fx_vectors(spark, sf_dir).where(F.col("doc_id") % 10 != 0)
    return v.select(F.col("doc_id").alias("candidate_id"), "label", "vec")


def fx_loss_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per author the lowest- and second-lowest-seq vectors as anchor and
    positive; batch_id = floor(author_id / 16)."""
    from pyspark.sql import Window

    v = fx_vectors(spark, sf_dir)
    w = Window.partitionBy("author_id").orderBy("seq", "doc_id")
    top2 = v.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 2)
    pairs = top2.groupBy("author_id").agg(
        F.max(F.when(F.col("rn") == 1, F.col("vec"))).alias("anchor_vec"),
        F.max(F.when(F.col("rn") == 2, F.col("vec"))).alias("positive_vec"),
    )
    return pairs.where(F.col("positive_vec").isNotNull()).select(
        "author_id",
        F.floor(F.col("author_id") / 16.0).cast("bigint").alias("batch_id"),
        "anchor_vec",
        "positive_vec",
    )


def fx_orders_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Larger author table for benchmarks (15k authors at sf0.1)."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").cast("string").alias("author_id"),
        F.col("o_orderkey").alias("doc_id"),
        F.col("o_orderkey").alias("seq"),
        F.concat_ws(" ", "o_orderstatus", "o_orderpriority", F.col("o_totalprice").cast("string")).alias(
            "full_text"
        ),
        F.when(F.col("o_orderkey") % 3 == 0, "query").otherwise("candidate").alias("side"),
    )


def fx_text_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` with the source as author: the skewed text case."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("author_id"),
        "doc_id",
        F.col("doc_id").alias("seq"),
        F.col("text").alias("full_text"),
    )
