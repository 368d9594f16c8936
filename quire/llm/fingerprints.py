"""Document fingerprints from closed syncmers, with DataFrame functions only.

Tokens are the words of a text, cut into pieces of at most five code points,
so text without spaces has tokens too. A run of ``K`` = 3 tokens is a closed
syncmer when the smallest of its token hashes lies at its first or last place.
That depends on the run alone, whatever the text's length, so an edit elsewhere
never moves or drops an anchor. Two thirds of all runs are anchors, and of two
neighbouring runs one always is: the middle token of both cannot be the
strictly smallest of either and of the other. So any four consecutive tokens
(about two words) that two texts share give them a common anchor. A text of
fewer than three tokens is one run.

A fingerprint holds every distinct anchor of its text (hash and token position,
first place of each), sorted by hash. :func:`likeness` counts the common
anchors of two fingerprints that agree on one offset of positions, over all
anchors of both: 1 for equal texts. Nothing is estimated from a part of the
anchors. Texts whose common parts lie at several offsets are judged by the
largest such part.
:func:`anchors` and :func:`matched_anchors` give the same as tables.

All of it is array functions on one row; a document never leaves its row, and
no key can be hot.

Defined results for odd input: a null text is empty; a text without words has
the fingerprint '' and likeness 1 to another such text, 0 to others; repeated
rows get equal fingerprints; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.arrays import let
from quire.operators.indexing import dense_index

TOKEN = r"[^\x20\x09-\x0D]{1,5}"
K = 3
#: Hashes below this one are kept: all of them.
SHARE = 1 << 63
_ANCHOR = "array<struct<hash:bigint,at:int>>"


def found_anchors(text: Column) -> Column:
    """Array of (hash, at), the closed syncmers of a text in order."""

    def runs(t: Column) -> Column:
        run = lambda i: F.struct(F.xxhash64(*[F.get(t, i + j) for j in range(K)]).alias("hash"), i.alias("at"))
        # the middle one is not the strictly smallest
        closed = lambda i: F.least(F.get(t, i), F.get(t, i + 2)) <= F.get(t, i + 1)
        many = F.transform(F.filter(F.sequence(F.lit(0), F.size(t) - K), closed), run)
        whole = F.array(F.struct(F.xxhash64(t).alias("hash"), F.lit(0).alias("at")))
        return F.when(F.size(t) >= K, many.cast(_ANCHOR)).when(F.size(t) > 0, whole.cast(_ANCHOR)).otherwise(F.array().cast(_ANCHOR))

    return let(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), 0), lambda x: F.xxhash64(x)), runs)


def _distinct(found: Column) -> Column:
    """Sorted by hash, each once, at its first place. ``sort_array`` compares
    values itself; ``array_sort`` would evaluate a lambda per comparison."""
    return let(F.sort_array(found), lambda z: F.filter(z, lambda x, i: ~F.coalesce(F.get(z, i - 1)["hash"] == x["hash"], F.lit(False))))


def sketch(found: Column) -> Column:
    """The distinct anchors of a fingerprint: struct of two arrays, hashes in
    order and their positions."""
    return let(_distinct(found), lambda a: F.struct(F.transform(a, lambda x: x["hash"]).alias("hash"), F.transform(a, lambda x: x["at"]).alias("at")))


def digest(s: Column) -> Column:
    """A sketch as text: 16 hex digits of each hash and eight of its position."""
    digits = lambda x, n: F.lpad(F.hex(x), n, "0")
    return F.lower(F.array_join(F.zip_with(s["hash"], s["at"], lambda h, at: F.concat(digits(h, 16), digits(at, 8))), ""))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two sketches, 0 to 1."""

    def compared(x: Column, y: Column) -> Column:
        # positions of the second side run down from -1, so among equal hashes they come first
        side = lambda s, place: F.zip_with(s["hash"], s["at"], lambda h, at: F.struct(h.alias("hash"), place(at).alias("at")))
        return let(F.sort_array(F.concat(side(x, lambda at: at), side(y, lambda at: F.lit(-1) - at))), counted)

    def counted(z: Column) -> Column:
        # a common hash stands twice, once of each side
        offset = lambda u, i: F.when(F.get(z, i - 1)["hash"] == u["hash"], u["at"] + F.get(z, i - 1)["at"])
        return let(F.filter(F.transform(z, offset), lambda o: o.isNotNull()), lambda o: largest(o) / (F.size(z) - F.size(o)))

    def largest(offsets: Column) -> Column:
        start = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

        def step(s: Column, o: Column) -> Column:
            run = F.when(s["last"] == o, s["run"] + 1).otherwise(1)
            return F.struct(o.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

        return F.aggregate(F.sort_array(offsets), start, step, lambda s: s["best"])

    none = lambda s: F.size(s["hash"]) == 0
    return F.when((a["hash"] == b["hash"]) & (a["at"] == b["at"]), 1.0).when(none(a) | none(b), 0.0).otherwise(compared(a, b))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document."""
    return docs.select(F.col("doc_id").cast("long"), digest(sketch(found_anchors(F.coalesce("text", F.lit(""))))).alias("fingerprint"))


def anchors(docs: DataFrame) -> DataFrame:
    """One row per anchor: doc_id, at (token position), hash."""
    d = docs.select(F.col("doc_id").cast("long"), F.explode(found_anchors(F.coalesce("text", F.lit("")))).alias("a"))
    return d.select("doc_id", "a.at", "a.hash")


def matched_anchors(left: DataFrame, right: DataFrame) -> DataFrame:
    """Positional matches of two anchor tables (:func:`anchors`): per pair of
    documents and offset of positions, how many anchors agree. An anchor is
    taken once per document, at its first place."""
    one = lambda df, p: df.groupBy("hash", F.col("doc_id").alias(p)).agg(F.min("at").alias(f"{p}_at"))
    j = one(left, "left_id").join(one(right, "right_id"), "hash")
    return j.groupBy("left_id", "right_id", (F.col("right_id_at") - F.col("left_id_at")).alias("shift")).agg(F.count(F.lit(1)).alias("n_anchors"))


def with_next(docs: DataFrame) -> DataFrame:
    """Each document beside the next one in descending ``doc_id`` (after the
    last: the first): doc_id, text, edited (the last half of the text replaced
    by as much of the next one's start), its and the next one's sketch.

    The order is found on narrow rows; then one shuffle brings texts to their
    keys, and one more carries each text to its predecessor, which takes its
    start from it and sketches it (a text is smaller than its sketch).
    Rows alike in id and text are one row with a count up to the end, as each
    but the last is followed by its like; null ids come last.
    """
    key = ["k", "x", "h"]
    d = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k"), F.col("doc_id").isNull().alias("x"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("h", F.xxhash64("text"))
    narrow = d.groupBy(*key).agg(F.any_value(F.length("text")).alias("n"), F.count(F.lit(1)).alias("rows"))
    placed = dense_index(narrow, [F.col("x"), F.col("k").desc(), F.col("h")], out="place")
    total = placed.agg(F.max("place") + 1).first()[0] or 1  # one number
    before = placed.select(F.pmod(F.col("place") + 1, F.lit(total)).alias("place"), *[F.col(c).alias(f"p_{c}") for c in key], F.expr("n div 2").alias("need"), "rows")
    links = placed.select(*key, "place").join(before, "place").drop("place")
    # both uses of ``texts`` read one exchange
    texts = d.groupBy(*key).agg(F.any_value("text").alias("text"))
    gives = texts.join(links, key).select(*[F.col(f"p_{c}").alias(c) for c in key], F.col("text").alias("after"), "need", "rows")
    own = texts.join(gives, key).withColumn("own", sketch(found_anchors(F.col("text")))).withColumn("next", sketch(found_anchors(F.col("after"))))
    own = own.withColumn("more", F.explode(F.sequence(F.col("rows") - 1, F.lit(0).cast("long"), F.lit(-1).cast("long"))))
    n = "length(text) div 2"
    start = F.when(F.col("more") > 0, F.expr(f"left(text, {n})")).otherwise(F.expr("left(after, need)"))
    return own.select(
        F.when(~F.col("x"), F.col("k")).alias("doc_id"), "text", F.concat(F.expr(f"left(text, length(text) - {n})"), start).alias("edited"),
        "own", F.when(F.col("more") > 0, F.col("own")).otherwise(F.col("next")).alias("next"),
    )


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses."""
    d = with_next(docs).withColumn("new", sketch(found_anchors(F.col("edited"))))
    return d.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        digest(F.col("own")).alias("fingerprint"),
        digest(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
