"""Training-set construction.

Each builder is a pure function of ``(documents, split, epoch)``: the epoch is
a parameter, not hidden state, and every random choice is a hash of
``(seed, tag, id)``, so an epoch can be rebuilt anywhere, in any partitioning,
and gives the same rows.

Documents are long rows ``(author_id, doc_id, seq, full_text, side)`` where
``doc_id`` is a unique row key and ``(side, seq)`` is arrival order.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.hashing import hash_int
from quire.operators import authors as A
from quire.operators.indexing import dense_index, grouped_running_sums
from quire.operators.sampling import epoch_seed, pick_hash, shuffle_key
from quire.session import stable

def side_rank():
    """Arrival order of roles: query files before candidate files."""
    return F.when(F.col("side") == "query", F.lit(0)).otherwise(F.lit(1))


class PairSet:
    """One epoch of cross-role pairs. ``qc``, ``eligible`` and the counts are
    ready on construction; ``cc`` and ``rows`` are built on first use, so a
    caller that needs only the query-candidate pairs does not pay for the
    draws or the shuffle."""

    def __init__(self, qc, eligible, make_cc, make_rows, n_query_authors, n_query_without_candidates,
                 n_candidate_authors, unmatched, n_eligible):
        self.qc: DataFrame = qc  # query-candidate pairs, one per query author
        self.eligible: DataFrame = eligible  # candidate-only authors with >= 2 candidate documents
        self._make_cc = make_cc
        self._make_rows = make_rows
        self.n_query_authors = n_query_authors
        self.n_query_without_candidates = n_query_without_candidates
        self.n_candidate_authors = n_candidate_authors  # A6: candidate ids after the split
        self.n_eligible = n_eligible
        self.unmatched: DataFrame = unmatched  # D3: query authors with no candidate document

    @cached_property
    def cc(self) -> DataFrame:
        """Candidate-candidate pairs, one per draw."""
        return self._make_cc()

    @cached_property
    def rows(self) -> DataFrame:
        """The epoch: qc + cc, shuffled, with position and batch."""
        return self._make_rows(self.cc)

    @property
    def expected_rows(self) -> int:
        """One qc row per query author that has candidates and, if any
        author is eligible, one cc row per query author."""
        draws = self.n_query_authors if self.n_eligible else 0
        return self.n_query_authors - self.n_query_without_candidates + draws


def attach_texts(pairs: DataFrame, docs: DataFrame, key: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Attach anchor and positive texts. Both document ids of every pair go
    through a single join with the documents (the large side is shuffled or
    streamed once, not once per role), then fold back to one row per pair."""
    key = list(key)
    roles = F.array(
        F.struct(F.lit(0).alias("r"), F.col("anchor_doc_id").alias("d")),
        F.struct(F.lit(1).alias("r"), F.col("positive_doc_id").alias("d")),
    )
    refs = pairs.select(*key, F.explode(roles).alias("x")).select(*key, "x.r", "x.d")
    found = refs.join(docs.select(F.col("doc_id").alias("d"), "full_text"), "d")
    texts = found.groupBy(*key).agg(
        F.max(F.when(F.col("r") == 0, F.col("full_text"))).alias("anchors"),
        F.max(F.when(F.col("r") == 1, F.col("full_text"))).alias("positives"),
    )
    return pairs.join(texts, key)


def split_authors(per_side: DataFrame, split_percent: float | None) -> tuple[DataFrame, DataFrame]:
    """R6 per role: the query and candidate author ids that the split keeps.
    ``per_side`` has one row per (author_id, side)."""
    ids = per_side.select("side", "author_id")
    if split_percent is not None:
        ids = A.prefix_split(ids, split_percent).where(F.col("selected") == 1).select("side", "author_id")
    return (
        ids.where(F.col("side") == "query").select("author_id"),
        ids.where(F.col("side") == "candidate").select("author_id"),
    )


def build_cross_role_pairs(
    docs: DataFrame,
    split: str,
    epoch: int,
    split_percent: float | None = None,
    strict: bool = True,
    compat_split: bool = False,
    batch_size: int = 64,
) -> PairSet:
    """``(anchors, positives)`` rows for one epoch.

    * qc: per query author one random query document and one random
      candidate document of the same author (R2, J2);
    * cc: as many draws as query authors, each a uniformly drawn (with
      replacement) candidate-only author with at least two candidate
      documents, and two distinct documents of it in random order (J5, P5,
      R3, R4);
    * rows: both, in a seeded shuffle (R5), numbered, with ``batch_id`` (R8).

    The split (R6) restricts which authors are used, never which of their
    documents. ``strict`` fails when a query author has no candidate
    document (D3) or nothing is eligible for augmentation (D4); otherwise
    such authors are dropped and counted. ``compat_split`` excludes only the
    query authors of the same split part from augmentation, as the reference
    did (D5).

    The documents are aggregated once per (author, role) — size and the
    seeded pick, both partial aggregates — and every author-level decision
    is taken on that small table.
    """
    seed = epoch_seed(split, epoch)
    # Only these four columns are needed; writing them once spares each later
    # stage a re-read and re-resolution of the documents.
    docs = stable(docs.select("author_id", "doc_id", "seq", "side"))
    per_side = stable(
        docs.groupBy("author_id", "side").agg(
            F.count(F.lit(1)).alias("n"), F.min_by(F.col("doc_id"), pick_hash(seed, "side")).alias("pick")
        )
    )
    q_ids, c_ids = split_authors(per_side, split_percent)
    q_rows = per_side.where(F.col("side") == "query").join(q_ids, "author_id", "left_semi")
    c_all = per_side.where(F.col("side") == "candidate")

    qc = q_rows.select("author_id", F.col("pick").alias("anchor_doc_id")).join(
        c_all.select("author_id", F.col("pick").alias("positive_doc_id")), "author_id", "inner"
    )

    all_q = per_side.where(F.col("side") == "query").select("author_id")
    blocked = q_ids if compat_split else all_q
    eligible = (
        c_all.join(c_ids, "author_id", "left_semi")
        .where(F.col("n") >= 2)
        .join(blocked, "author_id", "left_anti")
        .select("author_id", F.col("n").alias("n_candidate_docs"))
    )
    eligible = dense_index(eligible, ["author_id"], out="e_idx")

    def tag(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("what"))

    sizes = {
        r["what"]: int(r["n"])
        for r in tag(q_rows, "nq")
        .unionByName(tag(eligible, "ne"))
        .unionByName(tag(q_rows.join(c_all, "author_id", "left_anti"), "nmiss"))
        .unionByName(tag(c_ids, "nc"))
        .groupBy("what")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    }  # at most four rows: scalar counts
    nq, ne, nmiss, nc = (sizes.get(k, 0) for k in ("nq", "ne", "nmiss", "nc"))
    if strict and nmiss:
        raise ValueError(f"{nmiss} query authors have no candidate document")
    if strict and nq and not ne:
        raise ValueError("no candidate-only author has two candidate documents")
    cdocs = docs.where(F.col("side") == "candidate")

    def make_cc() -> DataFrame:
        spark = docs.sparkSession
        if ne:
            draws = spark.range(nq).withColumnRenamed("id", "draw").withColumn(
                "e_idx", F.pmod(hash_int(seed, "draw", "draw"), F.lit(ne))
            )
            drawn = draws.join(eligible.select("e_idx", "author_id", "n_candidate_docs"), "e_idx")
            # A uniform ordered pair of distinct positions among the author's
            # candidate documents, then a lookup by (author, position).
            n = F.col("n_candidate_docs")
            i1 = F.pmod(hash_int(seed, "first", "draw"), n)
            r2 = F.pmod(hash_int(seed, "second", "draw"), n - 1)
            drawn = drawn.withColumn("_i1", i1).withColumn("_r2", r2).withColumn(
                "_i2", F.when(F.col("_r2") >= F.col("_i1"), F.col("_r2") + 1).otherwise(F.col("_r2"))
            )
            pos = grouped_running_sums(
                cdocs.join(eligible.select("author_id"), "author_id", "left_semi")
                .select("author_id", "doc_id", "seq")
                .withColumn("_one", F.lit(1)),
                ["author_id"],
                ["seq", "doc_id"],
                ["_one"],
                pos_col="_pos",
            ).select("author_id", "_pos", "doc_id")
            # both positions of every draw go through one join with the position
            # table, then fold back to one row per draw
            refs = drawn.select(
                "draw",
                "author_id",
                F.explode(
                    F.array(
                        F.struct(F.lit(0).alias("r"), F.col("_i1").alias("_pos")),
                        F.struct(F.lit(1).alias("r"), F.col("_i2").alias("_pos")),
                    )
                ).alias("x"),
            ).select("draw", "author_id", "x.r", "x._pos")
            cc = (
                refs.join(pos, ["author_id", "_pos"])
                .groupBy("draw", "author_id")
                .agg(
                    F.max(F.when(F.col("r") == 0, F.col("doc_id"))).alias("anchor_doc_id"),
                    F.max(F.when(F.col("r") == 1, F.col("doc_id"))).alias("positive_doc_id"),
                )
            )
        else:
            a_type = docs.schema["author_id"].dataType.simpleString()
            d_type = docs.schema["doc_id"].dataType.simpleString()
            cc = spark.createDataFrame(
                [], f"draw bigint, author_id {a_type}, anchor_doc_id {d_type}, positive_doc_id {d_type}"
            )
        return cc

    def make_rows(cc: DataFrame) -> DataFrame:
        union = qc.select(
            F.lit("qc").alias("pair_kind"),
            F.concat(F.lit("qc|"), F.col("author_id")).alias("row_id"),
            "author_id",
            "anchor_doc_id",
            "positive_doc_id",
        ).unionByName(
            cc.select(
                F.lit("cc").alias("pair_kind"),
                F.concat(F.lit("cc|"), F.col("draw").cast("string")).alias("row_id"),
                "author_id",
                "anchor_doc_id",
                "positive_doc_id",
            )
        )
        rows = dense_index(union.withColumn("_key", shuffle_key(seed, "row_id")), ["_key", "row_id"], out="row_pos")
        rows = rows.drop("_key").withColumn("batch_id", F.floor(F.col("row_pos") / F.lit(batch_size)).cast("bigint"))
        return rows

    unmatched = q_rows.join(c_all, "author_id", "left_anti").select("author_id", F.col("n").alias("n_query_docs"))
    return PairSet(qc, eligible, make_cc, make_rows, nq, nmiss, nc, unmatched, ne)


def build_first_two_pairs(docs: DataFrame, split: str, epoch: int, with_text: bool = True) -> DataFrame:
    """C5 (W2, P3, R5): per author with more than one document, the first two
    documents in arrival order (all query documents, then candidates; by
    ``seq`` inside a role) as anchor and positive, in a seeded shuffle.

    ``row_number() <= 2`` keeps at most two rows per author and map task
    before the shuffle (partial WindowGroupLimit)."""
    seed = epoch_seed(split, epoch)
    w = Window.partitionBy("author_id").orderBy(side_rank(), F.col("seq"), F.col("doc_id"))
    top = docs.select("author_id", "doc_id", "seq", "side").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 2)
    pairs = top.groupBy("author_id").agg(
        F.max(F.when(F.col("rn") == 1, F.col("doc_id"))).alias("anchor_doc_id"),
        F.max(F.when(F.col("rn") == 2, F.col("doc_id"))).alias("positive_doc_id"),
    ).where(F.col("positive_doc_id").isNotNull())
    rows = dense_index(pairs.withColumn("_key", shuffle_key(seed, "author_id")), ["_key", "author_id"], out="row_pos")
    rows = rows.drop("_key")
    return attach_texts(rows, docs, ("author_id",)) if with_text else rows


def build_labelled_rows(docs: DataFrame, expanded_map: DataFrame, min_docs: int = 5) -> DataFrame:
    """C4 (P4, W1, P7): every document of an author with more than
    ``min_docs`` documents as ``(anchors, others='', labels)``, where the label
    is the author's position among all ids of the map. Rows are not shuffled;
    ``order_key`` is (author first seen, arrival order) for the writer."""
    counts = docs.groupBy("author_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct(side_rank().alias("r"), F.col("seq"), F.col("doc_id"))).alias("_first")
    )
    labels = A.label_ids(expanded_map).withColumnRenamed("id", "author_id")
    # author-level tables meet first; the documents are joined once
    big = counts.where(F.col("_n") > min_docs).join(labels, "author_id")
    out = docs.join(big, "author_id")
    return out.select(
        "author_id",
        "doc_id",
        F.col("full_text").alias("anchors"),
        F.lit("").alias("others"),
        F.col("label").cast("bigint").alias("labels"),
        F.struct(F.col("_first"), side_rank().alias("r"), F.col("seq"), F.col("doc_id")).alias("order_key"),
    )
