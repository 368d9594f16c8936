"""Texts written once, looked up every epoch.

An epoch needs the texts of a few documents per author, out of a corpus that
does not change between epochs. :func:`stored_texts` shuffles the texts once,
into a table bucketed by document id; every later join on that id moves only
the wanted ids to the buckets and reads the texts where they are. With fewer
ids than the broadcast threshold allows, Spark sends the ids instead; the texts
stay in place either way.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import scratch_path

BUCKET_BYTES = 128 << 20


def n_buckets(docs: DataFrame, text: str = "full_text", bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets of about ``bucket_bytes`` of text, at least one per core."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(total / bucket_bytes))


@contextmanager
def stored_texts(docs: DataFrame, key: str = "doc_id", text: str = "full_text", buckets: int | None = None) -> Iterator[DataFrame]:
    """``(key, text)`` as a table bucketed by ``key`` in the shared checkpoint
    folder. It is dropped with its files at the end of the block, so write what
    reads it inside. Rows without a key are left out: nothing can ask for them."""
    spark = docs.sparkSession
    rows = docs.select(key, text).where(F.col(key).isNotNull())
    n = buckets or n_buckets(rows, text)
    name = f"texts_{uuid.uuid4().hex}"
    path = scratch_path(spark, "texts")
    # the shuffle hashes as the buckets do, so a task writes one bucket file
    rows.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
