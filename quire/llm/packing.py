"""Packing along a space-filling curve.

Each document becomes a hashed vector (its token counts in ``buckets`` signed
hash buckets, unit length), is projected to three dimensions by a fixed random
matrix, and gets the Hilbert key of that point. Documents are range-sorted by
the key, so neighbours on the curve, which share vocabulary, follow one
another. The sorted token stream is cut every ``max_len`` tokens. What remains
at the very end is cut into powers of two, so no sequence needs padding.

Plan: tokenise once into a written table (ids compressed); one range shuffle
by (key, doc_id, row) into a second written table with running token counts
per partition; per-partition offsets (one number per partition) make positions
global. Equal keys, such as a third of all rows in one group of copies, are
split by doc_id and by row number, so no partition depends on a group.

Defined results for odd input: null text is empty; an empty document is its
end id alone; repeated rows are packed one by one; a null doc_id stays null
and sorts first; a text longer than a sequence spans several; an empty table
gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import wordhash as wh
from quire.llm.tokens import encoder
from quire.session import ship_package, stable

DIMS, BITS = 3, 16


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (rows x dims, each below 2**bits), by
    the transpose method: undo the excess work, Gray-encode, interleave."""
    x = [points[:, d].astype(np.int64).copy() for d in range(points.shape[1])]
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for d in range(dims):
            set_ = (x[d] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] ^= swap
        q >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    t = np.zeros(len(points), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[dims - 1] & q, q - 1, 0)
        q >>= 1
    key = np.zeros(len(points), np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | (((x[d] ^ t) >> b) & 1)
    return key


def curve_keys(ids: np.ndarray, borders: np.ndarray, buckets: int = 256, seed: int = 7) -> np.ndarray:
    """Hilbert key of every document from its token ids."""
    rows = len(borders) - 1
    h = wh.mix(ids.astype(np.uint64) + np.uint64(seed << 32))
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    doc = np.repeat(np.arange(rows), np.diff(borders))
    vec = np.bincount(doc * buckets + (h % np.uint64(buckets)).astype(np.int64), sign, rows * buckets).reshape(rows, buckets)
    vec /= np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-12)
    plane = np.random.default_rng(seed).standard_normal((buckets, DIMS))
    plane /= np.linalg.norm(plane, axis=0)
    top = (1 << BITS) - 1
    return hilbert_key(np.clip(((vec @ plane) + 1) / 2 * top, 0, top).round().astype(np.int64))


def tokenised(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """doc_id, key, n_tokens and compressed ids (with the end id) of every
    document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, z = encoder(tokenizer), zstandard.ZstdCompressor(level=1)
        kind = np.uint16 if max(enc.size, end_id + 1) <= 1 << 16 else np.uint32
        seq, task = 0, TaskContext.get().partitionId()
        for b in batches:
            for lo, hi, data, off in wh.blocks(wh.text_of(b)):
                ids, at = enc.encode(data, off)
                keys = curve_keys(ids, at)
                ids = np.insert(ids, at[1:], end_id).astype(kind)
                at = at + np.arange(len(at))
                raw = ids.tobytes()
                w = ids.itemsize
                packed = [z.compress(raw[at[k] * w : at[k + 1] * w]) for k in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0)[lo:hi],
                        pa.array(keys),
                        pa.array((np.int64(task) << 40) + seq + np.arange(hi - lo)),
                        pa.array(np.diff(at)),
                        pa.array(np.full(hi - lo, w, np.int32)),
                        pa.array(packed, pa.binary()),
                    ],
                    ["doc_id", "key", "row", "n_tokens", "width", "ids"],
                )
                seq += hi - lo

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        wh.trimmed(run), "doc_id long, key long, row long, n_tokens long, width int, ids binary"
    )


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the partition number and the tokens before each row in it."""
    so_far, task = 0, TaskContext.get().partitionId()
    for b in batches:
        n = b.column(b.schema.get_field_index("n_tokens")).to_numpy()
        before = so_far + np.cumsum(n) - n
        so_far += int(n.sum())
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(np.full(len(n), task, np.int32)), pa.array(before)], [*b.schema.names, "part", "before"]
        )


def cut_points(start: int, end: int, total: int, max_len: int) -> list[tuple[int, int, int, int]]:
    """Pieces of the stream span [start, end): (start, end, sequence, offset).
    Sequences are ``max_len`` long up to the last full one; the rest of the
    stream falls into powers of two, largest first."""
    full = total // max_len
    out = []
    while start < end:
        seq = start // max_len
        if seq < full:
            lo, hi = seq * max_len, (seq + 1) * max_len
        else:
            lo, rest, seq = full * max_len, total - full * max_len, full
            while True:
                hi = lo + (1 << (rest.bit_length() - 1))
                if start < hi:
                    break
                rest -= hi - lo
                lo, seq = hi, seq + 1
        stop = min(end, hi)
        out.append((start, stop, seq, start - lo))
        start = stop
    return out


def pack(docs: DataFrame, max_len: int = 4096, tokenizer: str | None = None, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and, ``with_ids``, the piece's ids as little-endian
    unsigned 32-bit numbers."""
    ship_package(docs.sparkSession)
    table = stable(tokenised(docs, tokenizer, end_id))
    order = [F.col("key"), F.col("doc_id"), F.col("row")]
    ranged = table.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stable(
        ranged.mapInArrow(_running, "doc_id long, key long, row long, n_tokens long, width int, ids binary, part int, before long").drop("key", "row")
    )
    parts = ranged.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    everything = Window.orderBy("part")  # one row per partition
    offsets = parts.select(
        "part",
        (F.sum("t").over(everything) - F.col("t")).alias("base"),
        F.sum("t").over(Window.partitionBy(F.lit(0))).alias("total"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in (b.slice(lo, 512) for b in batches for lo in range(0, b.num_rows, 512)):
            rows = []
            for r in b.to_pylist():
                ids = np.frombuffer(z.decompress(r["ids"]), np.uint16 if r["width"] == 2 else np.uint32).astype("<u4")
                g = r["base"] + r["before"]
                for s, e, seq, at in cut_points(g, g + r["n_tokens"], r["total"], max_len):
                    piece = ids[s - g : e - g].tobytes()
                    rows.append((r["doc_id"], s - g, e - s, zlib.crc32(piece), r["n_tokens"], seq, at) + ((piece,) if with_ids else ()))
            cols = list(zip(*rows)) if rows else [[]] * (7 + with_ids)
            kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(kinds)],
            )

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return ranged.join(F.broadcast(offsets), "part").mapInArrow(wh.trimmed(run), schema)  # one row per partition
