"""Near-duplicate classes by DartMinHash signatures and banded joining.

A document is the set of its five-word windows (a shorter text is one window),
each of weight 1, however often it occurs. DartMinHash throws darts: for every
(element, weight band) a Poisson process over ranks, generated by hashing,
gives darts with a rank and a height. Darts under the element's weight with a
rank up to ``t / total weight`` count, about ``k ln k + 2k`` per document
whatever its length. Each dart falls on one of ``k`` coordinates by hash, and
the earliest per coordinate is the signature, so two documents agree on a
coordinate with the probability of their Jaccard similarity, the one that is
checked. Bands of ``rows`` coordinates are joined by equality. A link needs an
exact Jaccard similarity of the window sets of ``threshold`` or more; classes
are connected components.

Plan, for any group size:

1. One scan computes signatures. Equal texts (by md5) become one node, with
   partial aggregation, so exact copies never meet in a bucket. Buckets with
   the same members count once.
2. Every bucket links its members to three of them, the first by hashed
   order: stars, linear in the bucket. The distinct pairs are checked exactly
   on the window sets of the documents that share a bucket with another.
3. A bucket that still holds several components is compared in cells: members
   outside its largest component ("open") against all members, cut into
   blocks bounded by rows and windows on both sides. A cell counts the common
   windows of all its pairs from postings, which is the exact check, and
   returns a forest of the links it finds, at most one per member. No pair of
   different components that shares a bucket is left unchecked.
4. Components come from alternating large-star and small-star steps on narrow
   edge tables; nothing but counts reaches the driver.

With 25 bands of 4 a pair at similarity 0.8 shares no bucket with probability
2e-6, at 0.7 with 1e-3.

Defined results for odd input: null text is empty; texts without words form
classes of equal texts only; a null ``doc_id`` keeps its row and never names a
class that has other ids; repeated rows are copies; an empty table gives an
empty result; extra columns are ignored by :func:`near_classes` and returned
unchanged by :func:`drop_near_duplicates`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import wordhash as wh
from quire.session import ship_package, stable

_U = np.uint64
SHINGLE, K, ROWS, THRESHOLD = 5, 100, 4, 0.8
#: Hubs of a bucket (step 2); rows and windows of a block (step 3); common
#: windows that a cell expands at a time.
HUBS, BLOCK, BLOCK_WINDOWS, EXPAND = 3, 1024, 1 << 20, 1 << 21
_RANK_BITS = 42


def shingles(data: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows of every row of a block: row, hash, count; and the
    number of words per row. Sorted by row, then hash."""
    starts, ends, doc = wh.spans(data, off)
    word = wh.span_hash(wh.TABLES[0][data], starts, ends)
    n_words = np.bincount(doc, minlength=len(off) - 1)
    at = np.flatnonzero(wh.inside(doc, size))
    key, row = wh.window_hash(word, size)[at], doc[at]
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):
        first = np.concatenate([[0], np.cumsum(n_words)])
        key = np.concatenate([key, wh.span_hash(word, first[short], first[short + 1])])
        row = np.concatenate([row, short])
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    head = np.ones(len(key), bool)
    head[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(head)
    return row[at], key[at], np.diff(np.append(at, len(key))), n_words


def dart_signatures(row: np.ndarray, key: np.ndarray, weight: np.ndarray, rows: int, k: int = K, seed: int = 3) -> np.ndarray:
    """Weighted signatures (rows x k) of sparse weighted sets; rows without
    elements stay 0. A value names its dart by the dart's rank."""
    sig = np.zeros((rows, k), _U)
    total = np.bincount(row, weight, rows)
    todo, darts = np.flatnonzero(total > 0), k * math.log(k) + 2 * k
    while len(todo):
        number = np.full(rows, -1)
        number[todo] = np.arange(len(todo))
        mine = number[row] >= 0
        r, e, w = number[row[mine]], key[mine], weight[mine]
        limit = darts / total[todo]
        packed = []
        band = 0
        while len(e):
            low, high = (0.0, 1.0) if band == 0 else (2.0 ** (band - 1), 2.0**band)
            region = wh.mix(e + _U(seed * 1_000_003 + band * 7919))
            rr, ww, rank, m = r, w, np.zeros(len(e)), 0
            while len(region):
                h = wh.mix(region + _U(m * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
                rank = rank - np.log(((h >> _U(11)).astype(float) + 0.5) * 2.0**-53) / (high - low)
                go = rank <= limit[rr]
                region, rr, ww, rank, h = region[go], rr[go], ww[go], rank[go], h[go]
                g = wh.mix(h ^ _U(0xD6E8FEB86659FD93))
                height = low + (g >> _U(11)).astype(float) * 2.0**-53 * (high - low)
                hit = height < ww
                coord = wh.mix(g) % _U(k)
                slot = rr[hit].astype(_U) * _U(k) + coord[hit]
                packed.append((slot << _U(_RANK_BITS)) | (rank[hit].view(_U) >> _U(63 - _RANK_BITS)))
                m += 1
            more = w > high
            r, e, w, band = r[more], e[more], w[more], band + 1
        p = np.sort(np.concatenate(packed))
        slot = (p >> _U(_RANK_BITS)).astype(np.int64)
        first = np.ones(len(p), bool)
        first[1:] = slot[1:] != slot[:-1]
        got = np.zeros(len(todo) * k, _U)
        got[slot[first]] = (p[first] & _U((1 << _RANK_BITS) - 1)) + _U(1)
        got = got.reshape(len(todo), k)
        sig[todo] = got
        todo, darts = todo[(got == 0).any(1)], darts * 2
    return sig


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band of ``rows`` coordinates."""
    bands = sig.shape[1] // rows
    h = np.zeros((len(sig), bands), _U) + np.arange(bands, dtype=_U) * _U(0x9E3779B97F4A7C15)
    for i in range(rows):
        h = wh.mix(h + sig[:, i::rows][:, :bands] * _U(0xC2B2AE3D27D4EB4F))
    return h.view(np.int64)


def signature_table(docs: DataFrame, k: int = K, rows: int = ROWS) -> DataFrame:
    """doc_id, md, n (distinct windows) and band keys of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in wh.blocks(wh.text_of(b)):
                row, key, _, _ = shingles(data, off)
                n = np.bincount(row, minlength=hi - lo)
                sig = dart_signatures(row, key, np.ones(len(key)), hi - lo, k)
                keys = band_keys(sig, rows)
                some = n > 0
                at = np.concatenate([[0], np.cumsum(some * keys.shape[1])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0)[lo:hi],
                        b.column(1)[lo:hi],
                        pa.array(n),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(keys[some].reshape(-1))),
                    ],
                    ["doc_id", "md", "n", "bands"],
                )

    return _keyed(docs).mapInArrow(wh.trimmed(run), "doc_id long, md string, n long, bands array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.md5(text).alias("md"), text.alias("text"))


def _window_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        md = b.column(b.schema.get_field_index("md"))
        for lo, hi, data, off in wh.blocks(wh.text_of(b)):
            row, key, _, _ = shingles(data, off)
            at = np.searchsorted(row, np.arange(hi - lo + 1))
            short = (key >> _U(32)).astype(np.uint32)  # in order, as key is
            sets = [short[at[i] : at[i + 1]].tobytes() for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([md[lo:hi], pa.array(sets, pa.binary())], ["md", "set"])


def window_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The sorted 32-bit window hashes of one document per node (md, doc_id)."""
    keyed = _keyed(docs).withColumn("first", F.coalesce("doc_id", F.lit(0)))
    # one text per node: (md, smallest id) may still be a repeated row
    rows = keyed.join(nodes.select("md", "first"), ["md", "first"], "left_semi").select("md", "text")
    return rows.mapInArrow(wh.trimmed(_window_sets), "md string, set binary").groupBy("md").agg(F.any_value("set").alias("set"))


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, c = b.column(b.schema.get_field_index("set_a")), b.column(b.schema.get_field_index("set_b"))
        j = np.zeros(b.num_rows)
        for i in range(b.num_rows):
            x, y = (np.frombuffer(s[i].as_buffer(), np.uint32) for s in (a, c))
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            same = int((both[1:] == both[:-1]).sum())
            j[i] = same / max(len(both) - same, 1)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(j)], ["a", "b", "similarity"])


def checked(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose window sets have the similarity asked for. The
    larger side of the pair travels; a hot node is split by the skew join."""
    one = pairs.join(sets.select(F.col("md").alias("b"), F.col("set").alias("set_b")), "b")
    two = one.join(sets.select(F.col("md").alias("a"), F.col("set").alias("set_a")), "a")
    found = two.select("a", "b", "set_a", "set_b").mapInArrow(wh.trimmed(_check), "a string, b string, similarity double")
    return found.where(F.col("similarity") >= threshold - 1e-12)


def components(links: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) of every linked node, by
    large-star and small-star steps until no edge changes."""
    edges = stable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stable(small.select("e.*").where("u <> v").distinct())
    return stable(edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label"))


def _labelled(df: DataFrame, labels: DataFrame, name: str = "md") -> DataFrame:
    return df.join(labels.withColumnRenamed("node", name), name, "left").withColumn("label", F.coalesce("label", name))


def _forest(x: np.ndarray, y: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Positions of pairs (x, y) that join different components; ``parent``
    (component of every node, its smallest) is brought up to date."""
    at, taken = np.arange(len(x)), []
    while True:
        u, v = parent[x[at]], parent[y[at]]
        apart = u != v
        at, high, low = at[apart], np.maximum(u, v)[apart], np.minimum(u, v)[apart]
        if not len(at):
            return np.concatenate(taken) if taken else at
        node, first = np.unique(high, return_index=True)
        taken.append(at[first])
        parent[node] = low[first]
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


def cell_links(threshold: float = THRESHOLD, expand: int = EXPAND):
    """For one cell of a bucket: links of its ``left`` rows (open members) to
    its other rows. Two open members meet in two cells; the one that has the
    smaller on the left counts."""

    def run(table: pa.Table) -> pa.Table:
        md = np.array(table["md"].to_pylist(), object)
        rank = np.unique(md, return_inverse=True)[1]
        label = np.unique(np.array(table["label"].to_pylist(), object), return_inverse=True)[1]
        is_left, is_open = (table[c].to_numpy(zero_copy_only=False) for c in ("left", "open"))
        sets = [np.frombuffer(x, np.uint32) for x in table["set"].to_pylist()]
        n = np.array([len(x) for x in sets])
        left, right = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        out_a, out_b, out_j = [], [], []
        if len(left) and len(right):
            posting = np.concatenate([sets[i] for i in right])
            order = np.argsort(posting, kind="stable")
            posting, member = posting[order], np.repeat(np.arange(len(right)), n[right])[order]
            parent = np.arange(label.max() + 1)
            step = max(expand // len(right), 1)
            for s in range(0, len(left), step):
                mine = left[s : s + step]
                window = np.concatenate([sets[i] for i in mine])
                row = np.repeat(np.arange(len(mine)), n[mine])
                lo = np.searchsorted(posting, window, "left")
                size = np.searchsorted(posting, window, "right") - lo
                ends = np.cumsum(size)
                same = np.zeros(len(mine) * len(right), np.int64)
                p = 0
                while p < len(window):
                    done = ends[p - 1] if p else 0
                    q = max(p + 1, int(np.searchsorted(ends, done + expand, "right")))
                    c = size[p:q]
                    at = np.arange(c.sum()) + np.repeat(lo[p:q] - (ends[p:q] - c - done), c)
                    same += np.bincount(np.repeat(row[p:q] * len(right), c) + member[at], minlength=len(same))
                    p = q
                same = same.reshape(len(mine), len(right))
                alike = same / np.maximum(n[mine][:, None] + n[right][None, :] - same, 1)
                once = ~is_open[right][None, :] | (rank[mine][:, None] < rank[right][None, :])
                i, j = np.nonzero((alike >= threshold - 1e-12) & once)
                a, b = mine[i], right[j]
                pick = _forest(label[a], label[b], parent)
                out_a.append(md[a[pick]])
                out_b.append(md[b[pick]])
                out_j.append(alike[i[pick], j[pick]])
        a, b = (np.concatenate(x) if x else np.array([], object) for x in (out_a, out_b))
        return pa.table(
            {
                "a": pa.array(a.tolist(), pa.string()),
                "b": pa.array(b.tolist(), pa.string()),
                "similarity": pa.array(np.concatenate(out_j) if out_j else np.array([], float), pa.float64()),
            }
        )

    return run


def _cells(buckets: DataFrame, labels: DataFrame, sets: DataFrame, block: int, windows: int) -> DataFrame:
    """The rows of every cell of the buckets that hold several components."""
    member = _labelled(buckets.select("key", "md", "n"), labels)
    part = member.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    part = part.groupBy("key").agg(
        F.max(F.struct("c", "label", "w")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("c").alias("c"), F.sum("w").alias("w")
    ).where("parts > 1")
    blocks = lambda c, w: F.greatest(F.ceil(c / block), F.ceil(w / windows)).cast("int")
    part = part.select(
        "key", F.col("main.label").alias("main"),
        blocks(F.col("c") - F.col("main.c"), F.col("w") - F.col("main.w")).alias("n_left"), blocks(F.col("c"), F.col("w")).alias("n_right"),
    )
    spot = F.xxhash64("md")
    own = lambda n: F.pmod(spot, F.col(n)).cast("int")
    places = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    place = lambda i, j, left: F.struct(i.alias("i"), j.alias("j"), F.lit(left).alias("left"))
    as_right = places("n_left", lambda i: place(i, own("n_right"), False))
    as_left = places("n_right", lambda j: place(own("n_left"), j, True))
    member = member.join(part, "key").withColumn("open", F.col("label") != F.col("main"))
    member = member.select("key", "md", "label", "open", F.when(F.col("open"), F.concat(as_right, as_left)).otherwise(as_right).alias("places"))
    return member.join(sets, "md").select("key", "md", "label", "open", "set", F.explode("places").alias("p")).select("key", "p.*", "md", "label", "open", "set")


def near_links(
    docs: DataFrame, threshold: float = THRESHOLD, k: int = K, rows: int = ROWS, block: int = BLOCK, windows: int = BLOCK_WINDOWS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signature table, links between different texts, labels of linked
    texts). Links are enough to connect every class, not all its pairs."""
    ship_package(docs.sparkSession)
    table = stable(signature_table(docs, k, rows))
    first = F.coalesce("doc_id", F.lit(0))
    nodes = stable(table.where("n > 0").groupBy("md").agg(F.min(first).alias("first"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands")))
    member = nodes.select("md", "n", F.explode("bands").alias("key"))
    hub = lambda i: F.min(F.struct(F.xxhash64("md", F.lit(i)).alias("h"), "md", "n"))
    total = lambda i: F.sum(F.xxhash64("md", F.lit(100 + i)).cast("decimal(38,0)"))
    hubs = member.groupBy("key").agg(
        F.array(*[F.struct(hub(i)["md"].alias("md"), hub(i)["n"].alias("n")) for i in range(HUBS)]).alias("hubs"),
        F.count(F.lit(1)).alias("size"), total(0).alias("t0"), total(1).alias("t1"),
    ).where("size > 1")
    # buckets of the same members: one of them is enough
    hubs = hubs.groupBy("size", "t0", "t1").agg(F.min(F.struct("key", "hubs")).alias("b")).select("b.*")
    buckets = stable(member.join(hubs, "key").select("key", "md", "n", F.array_distinct("hubs").alias("hubs")))
    sets = stable(window_sets(docs, nodes.join(buckets.select("md").distinct(), "md", "left_semi")))
    pairs = buckets.select("md", "n", F.explode("hubs").alias("hub")).where(F.col("md") != F.col("hub.md"))
    pairs = pairs.where(F.least("n", "hub.n") >= F.greatest("n", "hub.n") * threshold)
    pairs = pairs.select(F.greatest("md", "hub.md").alias("a"), F.least("md", "hub.md").alias("b")).distinct()
    links = stable(checked(pairs, sets, threshold))
    cells = _cells(buckets, components(links), sets, block, windows)
    more = cells.groupBy("key", "i", "j").applyInArrow(cell_links(threshold), "a string, b string, similarity double")
    links = stable(links.union(more))
    return table, links, components(links)


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, k: int = K, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, md, class_id (smallest doc_id of its
    class), class_size (documents) and ``keep``, true for one row per class."""
    table, _, labels = near_links(docs, threshold, k, rows)
    m = _labelled(table.select("doc_id", "md"), labels)
    m = m.withColumn("no", F.row_number().over(Window.partitionBy("doc_id", "md").orderBy("label")))
    # nulls last among the rows of a class
    rank = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "md", "no")
    classes = m.groupBy("label").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("class_size"))
    same = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("md") == F.col("best.md")) & (F.col("no") == F.col("best.no"))
    return m.join(classes, "label").select("doc_id", "md", F.col("best.doc_id").alias("class_id"), "class_size", same.alias("keep"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row per class, columns unchanged."""
    kept = near_classes(docs, threshold).where("keep").select(F.col("doc_id").alias("k_doc"), F.col("md").alias("k_md"))
    row = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col("doc_id").cast("long").alias("_doc"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("_md"),
    )
    on = F.col("_doc").eqNullSafe(F.col("k_doc")) & (F.col("_md") == F.col("k_md"))
    row = row.join(kept, on, "left_semi")
    # a repeated row is kept once
    row = row.withColumn("_no", F.row_number().over(Window.partitionBy("_doc", "_md").orderBy("_md"))).where("_no = 1")
    return row.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
