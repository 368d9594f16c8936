"""Quality rules: gradient-boosted trees over document statistics.

Statistics of every whole text are computed per Arrow batch with numpy. A
boosted ensemble of shallow trees is fitted on a bounded, documented sample of
labelled rows, with monotonic constraints on chosen statistics, flattened into
numpy node arrays and applied to all documents in one vectorised pass. No
shuffle moves text: one scan reads the labelled sample, one scores everything.

Defined results for odd input:

- null, empty or wordless text: all counts 0, fails the base rule (too short);
- a null ``doc_id`` keeps its row; repeated rows are judged alike, one by one;
- no usable labels (empty table, null labels or one class): no trees are
  fitted and the base rule alone decides;
- an empty table gives an empty result; other columns are ignored by
  :func:`score_quality` and returned unchanged by :func:`filter_quality`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import wordhash as wh
from quire.session import ship_package

#: Counts that the base rule reads and every result carries.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics the trees see, with the direction in which a higher value may
#: move the score (0: free).
FEATURES = {
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_word_share": -1,
    "pipe_share": -1,
    "same_as_previous": -1,
    "distinct_share": 0,
    "mean_word": 0,
    "log_words": 0,
    "short_word_share": 0,
    "capital_share": 0,
    "digit_share": 0,
    "punct_share": 0,
    "words_per_line": 0,
    "log_lines": 0,
}

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in ".,;:!?\"'()-"]] = True
_CAPS = np.zeros(256, bool)
_CAPS[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_NL = np.zeros(256, bool)
_NL[10] = True


def _block_stats(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts (rows x COUNTS) and features (rows x FEATURES) of a block."""
    rows = len(off) - 1
    starts, ends, doc = wh.spans(data, off)
    words = np.bincount(doc, minlength=rows)
    values = wh.TABLES[0][data]
    word = wh.span_hash(values, starts, ends)
    woff = np.concatenate([[0], np.cumsum(words)])

    point = (data & 0xC0) != 0x80  # first byte of a code point
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(point, out=before[1:])
    length = before[ends] - before[starts]
    chars = wh.per_row(length, woff)

    # lines with a word; equal lines of one row share (row, hash)
    cut = np.unique(np.concatenate([off, np.flatnonzero(_NL[data]) + 1]))
    lo, hi = cut[:-1], cut[1:].copy()
    hi -= _NL[data[hi - 1]] if len(hi) else 0
    line_row = np.searchsorted(off, lo, "right") - 1
    wordy = np.searchsorted(starts, hi) > np.searchsorted(starts, lo)
    lo, hi, line_row = lo[wordy], hi[wordy], line_row[wordy]
    line = wh.mix(wh.span_hash(values, lo, hi) + line_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    dup_lines = np.bincount(line_row[wh.later_equal(line)], minlength=rows)
    lines = np.bincount(line_row, minlength=rows)

    # words of three-word windows that occur twice or more in their row
    repeat = np.zeros(rows, np.int64)
    here = np.flatnonzero(wh.inside(doc, 3))
    if len(here):
        win = wh.window_hash(word, 3)[here]
        win = wh.mix(win + doc[here].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(win)
        same = win[order[1:]] == win[order[:-1]]
        twice = np.zeros(len(win), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(len(word), bool)
        for k in range(3):
            covered[here[twice] + k] = True
        repeat = np.bincount(doc[covered], minlength=rows)

    mine = wh.mix(word + doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    again = np.bincount(doc[wh.later_equal(mine)], minlength=rows)
    runs = np.zeros(len(word), bool)
    runs[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    symbols = wh.per_row(_SYMBOLS[data], off)
    n, c, ln = np.maximum(words, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    feats = {
        "symbol_share": symbols / c,
        "dup_line_share": dup_lines / ln,
        "repeat_word_share": repeat / n,
        "pipe_share": wh.per_row(data == 124, off) / n,
        "same_as_previous": np.bincount(doc[runs], minlength=rows) / n,
        "distinct_share": 1 - again / n,
        "mean_word": chars / n,
        "log_words": np.log1p(words),
        "short_word_share": np.bincount(doc[length <= 3], minlength=rows) / n,
        "capital_share": wh.per_row(_CAPS[data], off) / c,
        "digit_share": wh.per_row(_DIGIT[data], off) / c,
        "punct_share": wh.per_row(_PUNCT[data], off) / c,
        "words_per_line": words / ln,
        "log_lines": np.log1p(lines),
    }
    counts = np.stack([words, chars, symbols, dup_lines, repeat], 1).astype(np.int64)
    return counts, np.stack([feats[f] for f in FEATURES], 1).astype(np.float64)


def text_stats(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Counts and features of a whole Arrow text column."""
    parts = [_block_stats(data, off) for _, _, data, off in wh.blocks(column)]
    if not parts:
        return np.zeros((0, len(COUNTS)), np.int64), np.zeros((0, len(FEATURES)))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def base_failed(counts: np.ndarray) -> np.ndarray:
    """Fewer than 50 words, or more than half of the words in repeated
    three-word windows."""
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


@dataclass(frozen=True)
class Trees:
    """A boosted ensemble as flat node arrays; a leaf points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            go = x[rows, self.feature[node]] <= self.threshold[node]
            node = np.where(go, self.left[node], self.right[node])
        return self.bias + self.value[node].sum(1)

    def proba(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit_trees(
    x: np.ndarray,
    y: np.ndarray,
    monotone: list[int],
    n_trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 64,
    l2: float = 1.0,
    min_leaf: int = 20,
    cut: float = 0.5,
) -> Trees:
    """Boost ``n_trees`` histogram trees on the logistic loss.

    ``monotone[f]`` is -1, 0 or 1. A split that breaks its direction is not
    taken, and both children are bounded by the middle of their values, so
    the whole ensemble is monotone in that feature.
    """
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    mean = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    bias = float(np.log(mean / (1 - mean)))
    score = np.full(len(y), bias)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, lo: float, hi: float, left_depth: int) -> int:
        me = len(nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        nodes.append([0, np.inf, me, me, float(np.clip(-gs / (hs + l2), lo, hi)) * rate])
        best = (1e-6, -1, 0, 0.0, 0.0)
        if left_depth and len(rows) >= 2 * min_leaf:
            whole = gs * gs / (hs + l2)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                c = code[rows, f]
                gl = np.cumsum(np.bincount(c, g[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(c, h[rows], len(e) + 1))[:-1]
                nl = np.cumsum(np.bincount(c, minlength=len(e) + 1))[:-1]
                vl = np.clip(-gl / (hl + l2), lo, hi)
                vr = np.clip(-(gs - gl) / (hs - hl + l2), lo, hi)
                gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - whole
                ok = (nl >= min_leaf) & (len(rows) - nl >= min_leaf) & ((vr - vl) * monotone[f] >= 0)
                gain = np.where(ok, gain, -1)
                b = int(np.argmax(gain))
                if gain[b] > best[0]:
                    best = (float(gain[b]), f, b, float(vl[b]), float(vr[b]))
        _, f, b, vl, vr = best
        if f >= 0:
            go, mid, m = code[rows, f] <= b, (vl + vr) / 2, monotone[f]
            low = grow(rows[go], g, h, mid if m < 0 else lo, mid if m > 0 else hi, left_depth - 1)
            high = grow(rows[~go], g, h, mid if m > 0 else lo, mid if m < 0 else hi, left_depth - 1)
            nodes[me][:4] = [f, float(edges[f][b]), low, high]
        return me

    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-score))
        first = len(nodes)
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), -8.0, 8.0, depth))
        at = np.full(len(y), first)
        tree = np.array(nodes[first:])
        for _ in range(depth):
            n = tree[at - first]
            go = x[np.arange(len(y)), n[:, 0].astype(int)] <= n[:, 1]
            at = np.where(go, n[:, 2], n[:, 3]).astype(int)
        score = score + tree[at - first, 4]
    a = np.array(nodes, float).reshape(-1, 5)
    return Trees(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4], np.array(roots), depth, bias, cut)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        _, x = text_stats(wh.text_of(b))
        flat = pa.array(x.reshape(-1))
        at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES))
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(at, flat), b.column(b.schema.get_field_index("y"))], ["x", "y"])


def train_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, cut: float = 0.5) -> Trees | None:
    """Fit the trees on at most ``max_rows`` labelled documents.

    The bound is a parameter because the sample is gathered on the driver
    (``max_rows`` rows of 14 numbers). It is the ``max_rows`` labels smallest
    by a hash of their id, so the same tables give the same trees.
    """
    ship_package(docs.sparkSession)
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .select("doc_id", F.col("quality").cast("double").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y")
        .limit(max_rows)
    )
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(picked), "doc_id")  # at most max_rows ids
        .select("doc_id", "text", "y")
        .mapInArrow(wh.trimmed(_feature_rows), "x array<double>, y double")
        .toArrow()
    )
    if not rows.num_rows:
        return None
    x = np.array(rows["x"].to_pylist(), float)
    y = rows["y"].to_numpy()
    order = np.lexsort([*x.T, y])  # rows arrive in any order
    x, y = x[order], y[order]
    return fit_trees(x, y, list(FEATURES.values()), cut=cut) if 0 < y.mean() < 1 else None


def _verdict(column: pa.Array, trees: Trees | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    counts, x = text_stats(column)
    failed = base_failed(counts)
    p = trees.proba(x) if trees is not None and len(x) else np.ones(len(x))
    return counts, failed, p, ~failed & (p >= (trees.cut if trees is not None else 0))


def score_quality(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, the trees'
    probability of good quality and the verdict ``kept``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, failed, p, kept = _verdict(wh.text_of(b), trees)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(counts[:, k]) for k in range(len(COUNTS))], pa.array(failed), pa.array(p), pa.array(kept)],
                ["doc_id", *COUNTS, "base_failed", "quality", "kept"],
            )

    ship_package(docs.sparkSession)
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, quality double, kept boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(wh.trimmed(run), schema)


def filter_quality(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """The rows of ``docs`` that pass, every column unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_verdict(wh.text_of(b), trees)[3]))

    ship_package(docs.sparkSession)
    return docs.mapInArrow(wh.trimmed(run), docs.schema)
