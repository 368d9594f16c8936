"""Substring dedup: words in repeated windows of a fixed length are removed.

Every window of ``size`` consecutive words is hashed (Rabin-Karp over word
hashes) and counted across the corpus. A window occurrence is repeated when
its word sequence also starts in a document with a smaller ``doc_id``; words
under repeated windows go, merged into maximal intervals of word positions.

Plan: documents are written once in compressed chunks of a few MB. A chunk
sends each distinct window once, with its smallest doc_id there, to the
window's bucket (one bucket per shuffle partition), so a passage that a third
of all documents share costs one entry per chunk, not per document. A bucket
sorts its windows and answers each chunk with the windows that start in a
smaller document elsewhere; what repeats inside a chunk, the chunk sees
itself. Windows travel packed, as 56 bits beside a bucket number from a
second, independent hash: about 62 bits on 50 partitions and more on a
larger cluster, so ``N`` windows have about ``N**2 / 2**(57 + log2(buckets))``
false matches (none expected at 1e8 windows, about 1 in 1e9 at 1e13).

Defined results for odd input: null, empty and wordless texts have 0 words;
texts shorter than a window lose nothing; repeated ``doc_id`` rows are judged
one by one and are not smaller than each other; a row without ``doc_id``
neither removes nor loses words; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import wordhash as wh
from quire.session import ship_package, stable

_U = np.uint64
SIZE = 13
_CHUNK = "chunk long, ids binary, known binary, offsets binary, text binary"


def _to_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z, seq, task = zstandard.ZstdCompressor(level=3), 0, TaskContext.get().partitionId()
    for b in batches:
        for lo, hi, data, off in wh.blocks(wh.text_of(b), 3 << 20):
            ids = b.column(0)[lo:hi]
            row = [
                (task << 32) + seq,
                ids.fill_null(0).to_numpy().astype(np.int64).tobytes(),
                ids.is_valid().to_numpy(zero_copy_only=False).tobytes(),
                off.tobytes(),
                z.compress(data.tobytes()),
            ]
            kinds = [pa.int64()] + [pa.binary()] * 4
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["chunk", "ids", "known", "offsets", "text"])
            seq += 1


class _Chunk:
    """A decoded chunk: its rows, words and windows, rows in doc_id order."""

    def __init__(self, ids: bytes, known: bytes, offsets: bytes, text: bytes, size: int, buckets: int):
        self.ids, self.known = np.frombuffer(ids, np.int64), np.frombuffer(known, bool)
        self.off = np.frombuffer(offsets, np.int64)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(text), np.uint8)
        self.starts, self.ends, self.doc = wh.spans(self.data, self.off)
        a, b = (wh.span_hash(t[self.data], self.starts, self.ends, k) for k, t in enumerate(wh.TABLES))
        at = np.flatnonzero(wh.inside(self.doc, size))
        at = at[self.known[self.doc[at]]]
        by_id = np.argsort(self.ids[self.doc[at]], kind="stable")
        self.at = at[by_id]
        self.low = wh.window_hash(a, size, 0)[self.at] >> _U(8)
        self.bucket = (wh.window_hash(b, size, 1)[self.at] % _U(buckets)).astype(np.int32)
        self.id = self.ids[self.doc[self.at]]

    def first(self) -> tuple[np.ndarray, np.ndarray]:
        """Which windows are the first of their sequence here (smallest id,
        then position), and the smallest id of every window's sequence."""
        key = named(self.low, self.bucket)
        order = np.argsort(key, kind="stable")  # keeps ids ascending
        k = key[order]
        head = np.ones(len(k), bool)
        head[1:] = k[1:] != k[:-1]
        lead = np.zeros(len(k), bool)
        lead[order[head]] = True
        least = np.empty(len(k), np.int64)
        runs = np.flatnonzero(head)
        least[order] = np.repeat(self.id[order[runs]], np.diff(np.append(runs, len(k))))
        return lead, least


def named(low: np.ndarray, bucket: np.ndarray | int) -> np.ndarray:
    """One 64-bit name of (56 bits, bucket) for lookups inside a chunk."""
    return low ^ (wh.mix(np.asarray(bucket, np.int64).astype(_U) + _U(1)))


def _pack_ids(ids: np.ndarray, z: zstandard.ZstdCompressor) -> bytes:
    """Ascending ids as byte planes of their steps."""
    return z.compress(np.diff(ids, prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack_ids(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64)[:, 0])


def _pack_low(low: np.ndarray) -> bytes:
    return low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _unpack_low(raw: bytes) -> np.ndarray:
    full = np.zeros((len(raw) // 7, 8), np.uint8)
    full[:, :7] = np.frombuffer(raw, np.uint8).reshape(-1, 7)
    return full.view("<u8")[:, 0].astype(_U)


def _chunk_rows(batch: pa.RecordBatch, size: int, buckets: int) -> Iterator[tuple[int, _Chunk]]:
    for r in batch.to_pylist():
        yield r["chunk"], _Chunk(r["ids"], r["known"], r["offsets"], r["text"], size, buckets)


def _windows(size: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for chunk, c in _chunk_rows(b, size, buckets):
                lead, _ = c.first()
                low, ids, bucket = c.low[lead], c.id[lead], c.bucket[lead]
                order = np.argsort(bucket, kind="stable")
                low, ids, bucket = low[order], ids[order], bucket[order]
                present, at = np.unique(bucket, return_index=True)
                ends = np.append(at[1:], len(bucket))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(present),
                        pa.array(np.full(len(present), chunk)),
                        pa.array([_pack_low(low[s:e]) for s, e in zip(at, ends)], pa.binary()),
                        pa.array([_pack_ids(ids[s:e], z) for s, e in zip(at, ends)], pa.binary()),
                    ],
                    ["bucket", "chunk", "low", "ids"],
                )

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket: for every chunk, its windows that start in a smaller document
    of another chunk."""
    low, ids, chunks, bucket = [], [], [], []
    for b in batches:
        for r in b.to_pylist():
            low.append(_unpack_low(r["low"]))
            ids.append(_unpack_ids(r["ids"]))
            chunks.append(r["chunk"])
            bucket.append(r["bucket"])
    if not low:
        return
    sent = np.repeat(np.arange(len(low)), [len(x) for x in low])
    low, ids = np.concatenate(low), np.concatenate(ids)
    key = named(low, np.array(bucket)[sent])
    order = np.argsort(key, kind="stable")
    k = key[order]
    head = np.ones(len(k), bool)
    head[1:] = k[1:] != k[:-1]
    runs = np.flatnonzero(head)
    least = np.repeat(np.minimum.reduceat(ids[order], runs), np.diff(np.append(runs, len(k))))
    later = np.sort(order[ids[order] > least])
    at = np.searchsorted(sent[later], np.arange(len(chunks) + 1))
    for i, (chunk, n) in enumerate(zip(chunks, bucket)):
        if at[i + 1] > at[i]:
            mine = later[at[i] : at[i + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([n], pa.int32()), pa.array([_pack_low(low[mine])], pa.binary())], ["chunk", "bucket", "low"])


_RESULT = "doc_id long, n_words long, n_removed long, removed array<struct<first:long,end:long>>, kept_text string"


def _cut(size: int, buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        told = [named(_unpack_low(r["low"]), r["bucket"]) for r in right.select(["bucket", "low"]).to_pylist()]
        told = np.unique(np.concatenate(told)) if told else np.zeros(0, _U)
        parts = []
        for batch in left.to_batches():
            for _, c in _chunk_rows(batch, size, buckets):
                _, least = c.first()
                key = named(c.low, c.bucket)
                hit = c.id > least
                if len(told):
                    at = np.minimum(np.searchsorted(told, key), len(told) - 1)
                    hit |= told[at] == key
                step = np.zeros(len(c.starts) + 1, np.int64)
                np.add.at(step, c.at[hit], 1)
                np.add.at(step, c.at[hit] + size, -1)
                gone = np.cumsum(step[:-1]) > 0
                parts.append(_kept(c, gone))
        return pa.concat_tables(parts) if parts else _EMPTY

    return run


def _kept(c: _Chunk, gone: np.ndarray) -> pa.Table:
    rows = len(c.ids)
    n_words, n_gone = np.bincount(c.doc, minlength=rows), np.bincount(c.doc[gone], minlength=rows)
    first_word = np.concatenate([[0], np.cumsum(n_words)])
    # maximal intervals of removed words, cut at document borders
    edge = np.ones(len(gone), bool)
    edge[1:] = (gone[1:] != gone[:-1]) | (c.doc[1:] != c.doc[:-1])
    s = np.flatnonzero(edge)
    e = np.append(s[1:], len(gone))
    s, e = s[gone[s]], e[gone[s]]
    base = first_word[c.doc[s]]
    spans = pa.StructArray.from_arrays([pa.array(s - base), pa.array(e - base)], ["first", "end"])
    per = np.concatenate([[0], np.cumsum(np.bincount(c.doc[s], minlength=rows))]).astype(np.int32)
    # kept words with one space after each, the last one dropped per row
    keep = np.flatnonzero(~gone)
    n = c.ends[keep] - c.starts[keep] + 1
    total = np.concatenate([[0], np.cumsum(n)])
    take = np.repeat(c.starts[keep] - total[:-1], n) + np.arange(total[-1])
    out = np.append(c.data, np.uint8(32))[take]
    out[total[1:] - 1] = 32
    words = np.concatenate([[0], np.cumsum(n_words - n_gone)])
    lo, hi = total[words[:-1]], total[words[1:]]
    raw = out.tobytes()
    text = [raw[a : max(a, b - 1)].decode() for a, b in zip(lo, hi)]
    return pa.table(
        {
            "doc_id": pa.array(c.ids, mask=~c.known),
            "n_words": pa.array(n_words),
            "n_removed": pa.array(n_gone),
            "removed": pa.ListArray.from_arrays(pa.array(per), spans),
            "kept_text": pa.array(text, pa.string()),
        }
    )


_EMPTY = pa.table(
    {
        "doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()),
        "removed": pa.array([], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), "kept_text": pa.array([], pa.string()),
    }
)


def drop_repeated_passages(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, the removed intervals
    of word positions (end exclusive) and the kept words, joined by spaces."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ship_package(docs.sparkSession)
    chunks = stable(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(wh.trimmed(_to_chunks), _CHUNK))
    sent = chunks.mapInArrow(wh.trimmed(_windows(size, buckets)), "bucket int, chunk long, low binary, ids binary")
    answers = sent.repartitionById(buckets, F.col("bucket")).mapInArrow(wh.trimmed(_answers), "chunk long, bucket int, low binary")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_cut(size, buckets), _RESULT)
