"""Author-id map sources.

The reference file is one JSON object ``{key: value, ...}``. Such a file is
one record, so Spark reads it in one task (``wholetext``); it is offered for
compatibility. The scalable form is JSON lines ``{"key": .., "value": ..}``
(or Parquet with the same columns), read in parallel, where the line position
is the file order that decides "last one wins".

:func:`read_id_map_ranges` reads the object form itself in parallel: the file
is split at quotation marks, which Spark does by byte ranges, and the running
number of unescaped quotes tells of every piece whether it stands inside a
string, whatever range it was read in.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.indexing import dense_index, grouped_running_sums
from quire.session import stable
from quire.sources.jsonl import with_arrival_seq


def read_id_map_object(spark: SparkSession, path: str) -> DataFrame:
    """``(map_key, map_value, pos)`` from a single JSON object file.

    A key repeated inside the object fails under Spark's default
    ``spark.sql.mapKeyDedupPolicy=EXCEPTION``; set it to ``LAST_WIN`` to keep
    the last one, as Python's ``json`` module does."""
    raw = spark.read.text(path, wholetext=True)
    m = raw.select(F.from_json("value", T.MapType(T.StringType(), T.StringType())).alias("m"))
    return m.select(F.posexplode("m").alias("pos", "map_key", "map_value")).select(
        "map_key", "map_value", F.col("pos").cast("bigint").alias("pos")
    )


def read_id_map_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(map_key, map_value, pos)`` from JSON lines ``{"key", "value"}``."""
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
    df = (
        spark.read.schema(schema)
        .json(path)
        .withColumn("file", F.col("_metadata.file_path"))
        .withColumn("_block", F.col("_metadata.file_block_start"))
        .withColumn("_row", F.monotonically_increasing_id())
    )
    return with_arrival_seq(df, out="pos").select(
        F.col("key").alias("map_key"), F.col("value").alias("map_value"), "pos"
    )


def read_id_map_ranges(spark: SparkSession, path: str) -> DataFrame:
    """``(map_key, map_value, pos)`` from files that hold one JSON object of
    strings each, every file read by byte ranges.

    As Python's ``json`` module does, a repeated key keeps its first place and
    its last value (over all files, in order of name). A file that is not an
    object of strings raises ``ValueError``; an empty one holds nothing."""
    pieces = (
        spark.read.option("lineSep", '"')
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_row"),
            "value",
        )
    )
    # the quote after a piece is escaped if an odd number of backslashes stands before it
    slashes = F.length("value") - F.length(F.rtrim("value", F.lit("\\")))
    pieces = pieces.withColumn("real", F.when(slashes % 2 == 1, F.lit(0)).otherwise(F.lit(1)).cast("bigint"))
    counted = grouped_running_sums(pieces, ["file"], ["_block", "_row"], ["real"], pos_col="_at")
    # tokens: 0 before the first quote, odd ones are strings, even ones stand between strings
    tokens = counted.groupBy("file", (F.col("cum_real") - F.col("real")).alias("t")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "value"))), lambda x: x["value"]), '"').alias("text")
    )

    def part(number: int):
        return F.max(F.when((F.col("t") > 0) & ((F.col("t") - 1) % 4 == number), F.col("text")))

    pairs = stable(
        tokens.groupBy("file", F.floor((F.col("t") - 1) / 4).cast("bigint").alias("pair")).agg(
            F.max(F.when(F.col("t") == 0, F.trim(F.col("text"), F.lit(_WHITE)))).alias("head"),
            part(0).alias("k"),
            F.trim(part(1), F.lit(_WHITE)).alias("colon"),
            part(2).alias("v"),
            F.trim(part(3), F.lit(_WHITE)).alias("tail"),
        )
    )
    head = F.col("pair") < 0
    whole = F.when(head, F.col("head").rlike(r"^\{(?:[ \t\r\n]*\})?$")).otherwise(
        F.col("k").isNotNull() & F.col("v").isNotNull() & (F.col("colon") == ":") & F.col("tail").isin(",", "}")
    )
    shape = (
        pairs.groupBy("file")
        .agg(
            F.count_if(~F.coalesce(whole, F.lit(False))).alias("bad"),
            F.max("pair").alias("last"),
            # where the object is closed: after its last pair, or at once
            F.max(F.when((F.col("tail") == "}") | (F.col("head") != "{"), F.col("pair"))).alias("closed"),
            F.count_if((F.col("tail") == "}") | (F.col("head") != "{")).alias("ends"),
        )
        .where((F.col("bad") > 0) | ~F.col("closed").eqNullSafe(F.col("last")) | (F.col("ends") != 1))
    )
    broken = shape.select(F.min("file")).first()[0]
    if broken is not None:
        raise ValueError(f"{broken} is not a JSON object of strings")

    def decoded(c: str):
        return F.from_json(F.concat(F.lit('["'), F.col(c), F.lit('"]')), "array<string>", {"mode": "FAILFAST"})[0]

    at = F.struct("file", "pair")
    entries = pairs.where(~head).select("file", "pair", decoded("k").alias("map_key"), decoded("v").alias("map_value"))
    entries = entries.groupBy("map_key").agg(F.max_by("map_value", at).alias("map_value"), F.min(at).alias("at"))
    return dense_index(entries, ["at"], out="pos").select("map_key", "map_value", "pos")


_WHITE = " \t\r\n"


def write_id_map_object(entries: DataFrame, path: str) -> None:
    """``(map_key, map_value, pos)`` as a folder of JSON objects, one a
    partition, in order of ``pos``."""

    def lines(batches):
        start = "{"
        for pdf in batches:
            out = []
            for k, v in zip(pdf["map_key"], pdf["map_value"]):
                out.append(f"{start}{json.dumps(k)}: {json.dumps(v)}")
                start = ","
            yield pd.DataFrame({"value": out})
        yield pd.DataFrame({"value": ["{}" if start == "{" else "}"]})

    ranged = entries.repartitionByRange("pos").sortWithinPartitions("pos")
    ranged.select("map_key", "map_value").mapInPandas(lines, "value string").write.mode("overwrite").text(path)
