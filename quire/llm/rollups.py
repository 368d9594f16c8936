"""Delta-maintained token counts by source, language and tokenizer version.

A batch of changes (upserts with a count, deletes) becomes signed rows: minus
what the ledger holds for each document it touches, plus what the batch says.
The rows go to the ledger, their sums to the totals; totals over all committed
batches are the counts, so nothing is ever recounted.

A batch commits by the creation of one marker file, after its ledger and
totals are written under the batch's own folder. Applying a committed batch
again changes nothing; applying one that failed half-way overwrites its
folders. A lost executor costs a task, a lost driver an uncommitted batch.

Changes and ledger rows meet by document id, rows are narrow, and sums are
partial before the shuffle, so a source with a third of all rows is no hot
key. Only the names of committed batches reach the driver.

Defined results for odd input: a null source or language is a group of its
own; a null text has 0 tokens; a null ``doc_id`` is one document; of several
changes to one document in a batch the one with the highest (seq, op,
version, tokens) counts; a delete of an unknown document changes nothing; an empty
batch commits and changes nothing; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tokenizer versions: patterns whose matches are the tokens.
TOKENIZERS = {
    "words-1": r"[^\x20\x09-\x0D]+",
    "pieces-2": r"[A-Za-z0-9]+|[^\x20\x09-\x0DA-Za-z0-9]",
}
GROUP = ["source", "lang", "version"]
_ROWS = "doc_id long, source string, lang string, version string, docs long, tokens long"
_CHANGE = ["doc_id", "op", "seq", *GROUP, "tokens"]


def n_tokens(text: Column, version: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[version])), F.lit(0)).cast("long")


class Rollup:
    """Token counts kept under a shared folder ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        """Names of the committed batches, in order of name."""
        path, fs = self._file("commits")
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def _read(self, kind: str) -> DataFrame:
        names = self.committed()
        if not names:
            return self.spark.createDataFrame([], _ROWS)
        return self.spark.read.schema(_ROWS).parquet(*[f"{self.path}/{kind}/{n}" for n in names])

    def ledger(self) -> DataFrame:
        """What every document counts for now."""
        now = self._read("ledger").groupBy("doc_id", *GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return now.where("docs <> 0 OR tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens of all committed batches."""
        sums = self._read("totals").groupBy(*GROUP).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 OR n_tokens <> 0")

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it was committed before. ``changes``:
        doc_id, op ('upsert' or 'delete'), seq, source, lang, version, tokens."""
        if batch in self.committed():
            return False
        changes = changes.select(*_CHANGE)
        order = F.struct("seq", "op", "version", "tokens", "source", "lang")
        last = changes.groupBy("doc_id").agg(F.max(order).alias("c")).select("doc_id", "c.*")
        touched = last.select(F.col("doc_id").alias("t_doc"))
        old = self.ledger()
        old = old.join(touched, old["doc_id"].eqNullSafe(touched["t_doc"]), "left_semi")
        minus = old.select("doc_id", *GROUP, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))
        plus = last.where("op = 'upsert'").select("doc_id", *GROUP, F.lit(1).cast("long").alias("docs"), F.col("tokens").cast("long"))
        signed = minus.unionByName(plus).groupBy("doc_id", *GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        signed.where("docs <> 0 OR tokens <> 0").write.mode("overwrite").parquet(f"{self.path}/ledger/{batch}")
        rows = self.spark.read.schema(_ROWS).parquet(f"{self.path}/ledger/{batch}")
        sums = rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.select(F.lit(None).cast("long").alias("doc_id"), *GROUP, "docs", "tokens").write.mode("overwrite").parquet(f"{self.path}/totals/{batch}")
        path, fs = self._file(f"commits/{batch}")
        fs.create(path, True).close()
        return True


def follow(changes: DataFrame, rollup: Rollup, checkpoint: str):
    """Apply a stream of changes, one micro-batch per commit; a micro-batch
    that is replayed after a failure is recognised by its number."""
    return (
        changes.writeStream.foreachBatch(lambda df, n: rollup.apply(f"stream-{n:012d}", df) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
