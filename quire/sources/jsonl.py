"""JSONL document sources.

Always read with an explicit schema (no inference pass, ids stay strings).
Arrival order, which the reference takes from file and line order, becomes
explicit columns: ``file`` (the path), ``_block`` and ``_row`` (position
inside the file split). Call :func:`with_arrival_seq` to number rows and fix
that order with a written table before any join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.indexing import split_index

# Fixed values (must equal the input layout): file names and folders of the
# official query/candidate release and of the filtered corpora.
OFFICIAL_DATA_DIR = {"A": "TA2/hrs_*/data", "B": "data"}
OFFICIAL_QUERIES = "*_input_queries.jsonl"
OFFICIAL_CANDIDATES = "*_input_candidates.jsonl"
ID_MAP_FILE = "author-set-ids-map.json"
FILTERED_QUERIES_SUFFIX = "_queries_filtered.jsonl"
FILTERED_CANDIDATES_SUFFIX = "_candidates_filtered.jsonl"
FILTERED_MARK = "filtered"

CORPUS_SCHEMA = T.StructType(
    [
        T.StructField("documentID", T.StringType()),
        T.StructField("fullText", T.StringType()),
        T.StructField("authorIDs", T.ArrayType(T.StringType())),
    ]
)
QUERY_SCHEMA = CORPUS_SCHEMA
CANDIDATE_SCHEMA = T.StructType(
    [
        T.StructField("documentID", T.StringType()),
        T.StructField("fullText", T.StringType()),
        T.StructField("authorSetIDs", T.ArrayType(T.StringType())),
    ]
)


def expand_path(template: str, fold: str | None = None, split: str | None = None) -> str:
    """Substitute ``{fold}`` and ``{split}`` in a path template."""
    out = template
    if fold is not None:
        out = out.replace("{fold}", fold)
    if split is not None:
        out = out.replace("{split}", split)
    return out


def _scan(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)  # a broken line is an error
    return df.withColumn("file", F.col("_metadata.file_path")).withColumn(
        "_block", F.col("_metadata.file_block_start")
    ).withColumn("_row", F.monotonically_increasing_id())


def read_corpus(
    spark: SparkSession, directory: str, split: str, extra: T.StructType | None = None, keep_raw: bool = False
) -> DataFrame:
    """S1 + S2 + P1 + U1: every ``{split}*.jsonl`` in ``directory`` except
    earlier ``*filtered*`` outputs (tested on the file name, not the whole
    path), with ``authorID`` = first element of ``authorIDs``. A name may be a
    single file or a folder of part files, as Spark writes them. ``extra``
    adds pass-through fields to the schema. ``keep_raw`` reads each line as
    text and parses the known fields from it, keeping the line in ``_raw`` so
    that a sink can write every original field, known or not (K1). No matching
    name is an empty table."""
    schema = CORPUS_SCHEMA if extra is None else T.StructType(CORPUS_SCHEMA.fields + extra.fields)
    pattern = f"{directory.rstrip('/')}/{split}*.jsonl"
    if not _matches(spark, pattern):
        columns = [*schema.fields, *([T.StructField("_raw", T.StringType())] if keep_raw else [])]
        return _no_scan(spark, T.StructType(columns)).withColumn("authorID", F.element_at("authorIDs", 1))
    if keep_raw:
        lines = spark.read.text(pattern)
        df = (
            lines.where(F.trim(F.col("value")) != "")
            .select(
                F.col("value").alias("_raw"),
                F.from_json("value", schema, {"mode": "FAILFAST"}).alias("_j"),
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("_block"),
                F.monotonically_increasing_id().alias("_row"),
            )
            .select("_j.*", "_raw", "file", "_block", "_row")
        )
    else:
        df = _scan(spark, pattern, schema)
    return df.where(~source_name("file").contains(FILTERED_MARK)).withColumn("authorID", F.element_at("authorIDs", 1))


def source_name(file: str):
    """The ``*.jsonl`` name that a row's path belongs to: the file itself, or
    the folder that holds the part file."""
    parts = F.split(F.col(file), "/")
    last = F.element_at(parts, -1)
    return F.when(last.endswith(".jsonl"), last).otherwise(F.element_at(parts, -2))


def _matches(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a pattern names, files or folders, as Spark's file system
    sees them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [f.getPath().toString() for f in found] if found else []


def _single_file(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    files = _matches(spark, pattern)  # a folder of part files counts as one file
    if len(files) != 1:
        raise ValueError(f"expected exactly one file for {pattern!r}, found {len(files)}")
    return _scan(spark, files[0], schema)


def read_official_queries(spark: SparkSession, pattern: str) -> DataFrame:
    """S3 + P1: the one ``*_input_queries.jsonl``; ``alias`` = authorIDs[0]."""
    df = _single_file(spark, pattern, QUERY_SCHEMA)
    return df.withColumn("alias", F.element_at("authorIDs", 1)).withColumn("side", F.lit("query"))


def read_official_candidates(spark: SparkSession, pattern: str) -> DataFrame:
    """S4 + P2: the one ``*_input_candidates.jsonl``; ``alias`` = authorSetIDs[0]."""
    df = _single_file(spark, pattern, CANDIDATE_SCHEMA)
    return df.withColumn("alias", F.element_at("authorSetIDs", 1)).withColumn("side", F.lit("candidate"))


def read_filtered_corpora(spark: SparkSession, prefix_glob: str) -> DataFrame:
    """S5 + U2: all ``<prefix>_queries_filtered.jsonl`` then all
    ``<prefix>_candidates_filtered.jsonl`` (the prefix may glob over corpora),
    as single files or as the folders that K1 writes
    (:func:`filtered_patterns`); ``author_id`` = authorIDs[0], ``side`` from
    the file. One role may be missing; that neither has a file is an error."""
    q = _scan_or_empty(spark, prefix_glob + FILTERED_QUERIES_SUFFIX, CORPUS_SCHEMA).withColumn("side", F.lit("query"))
    c = _scan_or_empty(spark, prefix_glob + FILTERED_CANDIDATES_SUFFIX, CORPUS_SCHEMA).withColumn(
        "side", F.lit("candidate")
    )
    if not (_existing(spark, prefix_glob + FILTERED_QUERIES_SUFFIX) or _existing(spark, prefix_glob + FILTERED_CANDIDATES_SUFFIX)):
        raise FileNotFoundError(f"no filtered corpus matches {prefix_glob!r}")
    return q.unionByName(c).withColumn("author_id", F.element_at("authorIDs", 1))


def filtered_patterns(pattern: str) -> list[str]:
    """The two places of a filtered file ``<dir>/<split>_<role>_filtered.jsonl``:
    that path, and the folder ``<dir>/<split>/output=<split>_<role>_filtered``
    of :func:`quire.sources.writers.write_filtered_lines`."""
    folder, _, name = pattern.rpartition("/")
    stem = name.removesuffix(".jsonl")
    split = stem.rsplit("_", 2)[0]
    return [pattern, f"{folder}/{split}/output={stem}"]


def _existing(spark: SparkSession, pattern: str) -> list[str]:
    return [p for p in filtered_patterns(pattern) if _matches(spark, p)]


def _scan_or_empty(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """A pattern that matches no file is an empty input; any other failure is
    raised."""
    paths = _existing(spark, pattern)
    return _scan(spark, paths, schema) if paths else _no_scan(spark, schema)


def _no_scan(spark: SparkSession, schema: T.StructType) -> DataFrame:
    empty = spark.createDataFrame([], schema)
    return (
        empty.withColumn("file", F.lit(None).cast("string"))
        .withColumn("_block", F.lit(None).cast("bigint"))
        .withColumn("_row", F.lit(None).cast("bigint"))
    )


def with_arrival_seq(df: DataFrame, out: str = "seq") -> DataFrame:
    """Number rows in arrival order: queries before candidates, then file
    path, split start and position inside the split. A scan delivers the rows
    of a split in order, so only one row per split is ordered
    (:func:`quire.operators.indexing.split_index`); no text is shuffled."""
    side_rank = F.when(F.col("side") == "query", 0).otherwise(1) if "side" in df.columns else F.lit(0)
    keyed = df.withColumn("_side_rank", side_rank)
    out_df = split_index(keyed, ["_side_rank", "file", "_block"], "_row", out=out)
    return out_df.drop("_side_rank", "_block", "_row")
