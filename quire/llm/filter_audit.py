"""Filter interaction audit with higher-order SQL folds.

Every document gets a mask with one bit per filter it fails. Documents of one
part and mask are one cell, so at most ``2**5`` cells per part remain, however
large the table. Each cell then folds over the constant array of all orders
(``aggregate`` over the filters of an order, ``transform`` over the orders) and
makes one struct per order and step, weighted by its documents; the structs of
a part's cells are added element by element.

Plan: one scan makes narrow rows (id, part, text digest, mask), written once.
The fifth filter needs the smallest id of every text: an aggregate by digest
with map-side combine, joined back by (digest, id), so a text that a third of
all documents share is spread by their ids. Labels join by id. After the cells'
aggregate nothing grows with the documents; no cross join, no Python.

Defined results for odd input: a null text is empty; a null ``lang`` belongs
to the part ``''``; a row without ``doc_id`` never fails E, makes no other row
fail it and has no labels; repeated rows count one by one and are not smaller
than each other; labels of one document that differ count if any is 1, null
labels are 0; an empty table gives an empty result; extra columns are ignored.
Whole texts are read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import stable

FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: Fixed limits and characters of the five filters.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, MARKS = 100, 80, 10, r"[#$%&*|]"


def row_filters(text: Column) -> list[Column]:
    """Failures of A to D, which need the text alone."""
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")
    n = F.size(words)
    return [
        n < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > MAX_CAPITALS * F.length(text),
        text.rlike(MARKS),
    ]


def document_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask (bit ``i`` is set if the filter ``i`` fails)."""
    text = F.coalesce("text", F.lit(""))
    bits = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(row_filters(text))), F.lit(0))
    d = stable(docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), bits.alias("low")))
    first = d.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    later = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return d.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("low") + F.when(later, 16).otherwise(0)).alias("mask"))


def mask_cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part and mask: n documents, good and toxic ones."""
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    both = masks.join(marks, "doc_id", "left")
    return both.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def _steps(orders: Column, n_filters: int) -> Column:
    """The cell's structs, one per order and step: a fold over each order that
    carries whether the cell is still there and the structs so far."""
    fails = F.array(*[F.col("mask").bitwiseAND(F.lit(1 << i)) != 0 for i in range(n_filters)])
    alone = F.bit_count("mask") == 1
    none = F.lit(0).cast("long")
    record = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"

    def step(state: Column, f: Column) -> Column:
        alive, fail = state["alive"], F.get(fails, f)
        gone = alive & fail
        here = F.struct(
            F.when(alive & ~fail, F.col("n")).otherwise(none).alias("kept"),
            F.when(gone, F.col("n")).otherwise(none).alias("removed"),
            F.when(~alive & fail, F.col("n")).otherwise(none).alias("redundant"),
            F.when(fail & alone, F.col("n")).otherwise(none).alias("unique_fails"),
            F.when(gone, F.col("good")).otherwise(none).alias("good_lost"),
            F.when(gone, F.col("toxic")).otherwise(none).alias("toxic_lost"),
        )
        return F.struct((alive & ~fail).alias("alive"), F.concat(state["out"], F.array(here.cast(record))).alias("out"))

    start = F.struct(F.lit(True).alias("alive"), F.array().cast(f"array<{record}>").alias("out"))
    return F.flatten(F.transform(orders, lambda o: F.aggregate(o, start, step, lambda s: s["out"])))


def fold_orders(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """All orders of the filters over the cells (part, mask, n, good, toxic):
    part, filter_order, step, the six counts and shapley."""
    k = len(filters)
    every = sorted(permutations(range(k)))
    orders = F.array(*[F.array(*[F.lit(i) for i in o]) for o in every])
    names = F.array(*[F.lit("".join(filters[i] for i in o)) for o in every])
    at = F.array(*[F.lit(i) for o in every for i in o])  # the filter of every struct
    add = lambda a, b: F.struct(*[(a[c] + b[c]).alias(c) for c in COUNTS])
    # at most 2**k cells a part
    parts = cells.withColumn("steps", _steps(orders, k)).groupBy("part").agg(F.collect_list("steps").alias("all"))
    parts = parts.select("part", F.aggregate(F.slice("all", 2, 1 << k), F.get("all", F.lit(0)), lambda a, b: F.zip_with(a, b, add)).alias("steps"))
    removed = F.transform("steps", lambda s: s["removed"])
    by_filter = [
        F.aggregate(F.zip_with(removed, at, lambda r, f: F.when(f == i, r).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a + b) for i in range(k)
    ]
    rows = parts.select("part", F.array(*by_filter).alias("total"), F.posexplode("steps").alias("pos", "s"))
    return rows.select(
        "part",
        F.get(names, F.expr(f"pos div {k}").cast("int")).alias("filter_order"),
        (F.col("pos") % k + 1).cast("int").alias("step"),
        *[F.col("s")[c].alias(c) for c in COUNTS],
        F.get("total", F.get(at, F.col("pos"))).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over ``docs`` in all orders, per part."""
    return fold_orders(mask_cells(document_masks(docs), labels))
