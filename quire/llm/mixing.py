"""Mixing sources to target weights with a low-discrepancy schedule.

Sources get targets by water-filling: shares by weight, at most ``max_epochs``
times a source's size, the excess reshared by weight. Every source's documents
are put in a hashed order and its word stream is cut into equal blocks. Slot
``i`` of the schedule maps the golden-ratio point ``frac(i * phi)`` through the
cumulative slot weights to a source, slots are ranked per source, and the slot
of rank ``r`` takes block ``r mod n_blocks``. The mix is the join of slots and
blocks, so a prefix of the schedule is already well mixed.

DataFrame functions only. Sizes come from one scan; everything after moves
narrow rows. Ranks and word offsets are running counts over range partitions
(:func:`quire.operators.indexing.grouped_running_sums`), so a source with a
third of all rows is spread like any other. The slot-block join is on (source,
block), which splits a hot source. Only the table of sources (one row per
source) is gathered and sorted in one task.

Defined results for odd input: a null or wordless text has size 0 and nothing
is taken from it; a null source is a source of its own, last in order;
repeated rows count one by one; if all sizes are 0 every target is 0; an empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.hashing import hash_int
from quire.operators.indexing import grouped_running_sums
from quire.session import stable

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: 2**32 / golden ratio, odd: multiples modulo 2**32 are the golden points.
GOLDEN = 2654435769
TWO32 = 1 << 32


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def golden_point(i: Column) -> Column:
    """frac(i * phi) to 32 bits, in [0, 1), with products below 2**63."""
    low = F.pmod(i, F.lit(TWO32))
    high, rest = F.shiftrightunsigned(low, 16), low.bitwiseAND(F.lit(0xFFFF))
    top = F.pmod(high * F.lit(GOLDEN), F.lit(TWO32)).bitwiseAND(F.lit(0xFFFF))
    return F.pmod(F.shiftleft(top, 16) + rest * F.lit(GOLDEN), F.lit(TWO32)) / F.lit(float(TWO32))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = 3, block_words: int = 64, min_slots: int = 512) -> DataFrame:
    """One row per source: sid, source, source_size, target, block (words of
    a block), n_blocks and its span (w_from, w_to) of the w_all slots.

    Blocks are at most ``block_words`` words, and small enough that a source
    fills ``min_slots`` slots, so the schedule's error of a few slots stays
    small for small sources too.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    whole = Window.partitionBy(F.lit(0))
    s = per.withColumn("sid", (F.row_number().over(by_name) - 1).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_epochs))
    # water-filling: sources are filled up in the order of cap / weight; the
    # first that is not full fixes the level of all that follow
    fill = F.col("cap") / F.col("weight")
    below = Window.orderBy(fill, "sid").rowsBetween(Window.unboundedPreceding, -1)
    words_left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))
    s = s.withColumn("level", words_left / weight_left).withColumn("full", fill <= F.col("level"))
    first = F.min(F.when(~F.col("full"), F.struct(fill.alias("fill"), "sid", "level"))).over(whole)
    s = s.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.least(first["level"] * F.col("weight"), F.col("cap"))))
    s = s.withColumn("block", F.floor(F.greatest(F.lit(1.0), F.least(F.lit(float(block_words)), F.col("target") / float(min_slots)))).cast("long"))
    s = s.withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long")).withColumn("slots", F.col("target") / F.col("block"))
    return s.select(
        "sid", "source", "source_size", "target", "block", "n_blocks",
        (F.sum("slots").over(by_name) - F.col("slots")).alias("w_from"),
        F.sum("slots").over(by_name).alias("w_to"),
        F.sum("slots").over(whole).alias("w_all"),
    )


def source_schedule(targets: DataFrame, max_epochs: int = 3) -> DataFrame:
    """The schedule: slot, sid, rank in its source, epoch and block.

    A slot finds its source by an equi-join on the cell of its point, of four
    cells per source: the points are spread evenly, so no cell is hot.
    """
    spark = targets.sparkSession
    n_sources, total = targets.agg(F.count(F.lit(1)), F.max("w_all")).first()  # two numbers
    cells = max(1024, 4 * n_sources)
    u = golden_point(F.col("id"))
    slots = spark.range(int(round(total or 0.0))).select(F.col("id").alias("slot"), u.alias("u"), F.floor(u * cells).alias("cell"))
    lo, hi = F.col("w_from") / F.col("w_all"), F.col("w_to") / F.col("w_all")
    spans = targets.where("w_to > w_from").select(
        "sid", "n_blocks", lo.alias("lo"), F.when(F.col("w_to") >= F.col("w_all"), 2.0).otherwise(hi).alias("hi"),
        F.explode(F.sequence(F.floor(lo * cells), F.least(F.floor(hi * cells), F.lit(cells - 1)))).alias("cell"),
    )
    placed = slots.join(spans, "cell").where("u >= lo AND u < hi").select("slot", "sid", "n_blocks")
    ranked = grouped_running_sums(placed, ["sid"], ["slot"], [], pos_col="rank")
    return ranked.where(F.col("rank") < max_epochs * F.col("n_blocks")).select(
        "slot", "sid", "rank", F.expr("rank div n_blocks").alias("epoch"), F.expr("rank % n_blocks").alias("block_no")
    )


def document_streams(sizes: DataFrame, targets: DataFrame, seed: int = 11) -> DataFrame:
    """Every document with its place (begin, end) in its source's word stream,
    in hashed order: doc_id, sid, size, source_size, target, block, begin, end."""
    t = targets.select("sid", "source", "source_size", "target", "block")
    d = sizes.join(t, sizes["source"].eqNullSafe(t["source"])).drop("source")
    d = d.withColumn("shuffled", hash_int(seed, "mix", F.coalesce(F.col("doc_id"), F.lit(0))))
    d = grouped_running_sums(d, ["sid"], ["shuffled", "doc_id", "size"], ["size"])
    return d.select(
        "doc_id", "sid", "size", "source_size", "target", "block",
        (F.col("cum_size") - F.col("size")).alias("begin"), F.col("cum_size").alias("end"),
    )


def mixed(streams: DataFrame, schedule: DataFrame) -> DataFrame:
    """The mix, one row per document piece of a slot: slot, epoch, sid,
    block_no, doc_id, begin (of the document), first_word, words."""
    lo, hi = F.col("block_no") * F.col("block"), (F.col("block_no") + 1) * F.col("block")
    pieces = (
        streams.where("size > 0")
        .withColumn("block_no", F.explode(F.expr("sequence(begin div block, (end - 1) div block)")))
        .select(
            "sid", "block_no", "doc_id", "begin",
            (F.greatest("begin", lo) - F.col("begin")).alias("first_word"),
            (F.least("end", hi) - F.greatest("begin", lo)).alias("words"),
        )
    )
    return schedule.select("slot", "epoch", "sid", "block_no").join(pieces, ["sid", "block_no"])


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = 3, block_words: int = 64, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """The mix of all documents and, per document, what it takes:
    (mix rows, [doc_id, sid, source, size, source_size, target, begin, taken])."""
    sizes = stable(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), n_words(F.col("text")).alias("size")))
    targets = stable(source_targets(sizes, weights, max_epochs, block_words))
    streams = document_streams(sizes, targets, seed)
    mix = mixed(streams, source_schedule(targets, max_epochs))
    taken = mix.groupBy("sid", "begin").agg(F.sum("words").alias("taken"))
    key = F.when(F.col("size") > 0, F.col("begin"))  # an empty document has no place of its own
    per_doc = (
        streams.withColumn("key", key)
        .join(taken.withColumnRenamed("begin", "key"), ["sid", "key"], "left")
        .join(targets.select("sid", "source"), "sid")
        .select("doc_id", "sid", "source", "size", "source_size", "target", "begin", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )
    return mix, per_doc


def apply_mix(docs: DataFrame, per_doc: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them, columns unchanged: a document appears
    once per whole time it is taken; a rest of ``k`` words is one more row
    with its first ``k`` words, joined by spaces (``n_chars`` follows the
    text). What is not taken goes."""
    cols = docs.columns
    key = [F.col("doc_id").cast("long").alias("_k_doc"), F.col("source").cast("string").alias("_k_source")]
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), *key, n_words(F.col("text")).alias("_k_size"))
    keys = ["_k_doc", "_k_source", "_k_size"]
    # rows alike in id, source and size are told apart by number
    d = d.withColumn("_k_no", F.row_number().over(Window.partitionBy(*keys).orderBy(F.md5(F.col("_row.text")))))
    p = per_doc.where("taken > 0").select(
        F.col("doc_id").alias("p_doc"), F.col("source").alias("p_source"), F.col("size").alias("p_size"), "taken",
        F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy("begin")).alias("p_no"),
    )
    on = F.col("_k_doc").eqNullSafe(F.col("p_doc")) & F.col("_k_source").eqNullSafe(F.col("p_source"))
    j = d.join(p, on & (F.col("_k_size") == F.col("p_size")) & (F.col("_k_no") == F.col("p_no")))
    j = j.withColumn("_words", F.explode(F.expr(
        "concat(array_repeat(_k_size, cast(taken div _k_size as int)), if(taken % _k_size > 0, array(taken % _k_size), array()))"
    )))
    part = F.array_join(F.slice(F.regexp_extract_all(F.col("_row.text"), F.lit(WORD), 0), 1, F.col("_words").cast("int")), " ")
    j = j.withColumn("_text", F.when(F.col("_words") < F.col("_k_size"), part).otherwise(F.col("_row.text")))
    kinds = dict(docs.dtypes)
    out = {c: F.col("_row")[c] for c in cols} | {"text": F.col("_text")}
    if "n_chars" in cols:
        out["n_chars"] = F.when(F.col("_words") < F.col("_k_size"), F.length("_text")).otherwise(F.col("_row.n_chars")).cast(kinds["n_chars"])
    return j.select(*[v.alias(c) for c, v in out.items()])
