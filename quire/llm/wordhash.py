"""Words and rolling hashes of whole Arrow text columns, with numpy.

A text column arrives from Spark as one UTF-8 buffer plus offsets. The helpers
here find every word of every row and hash words, lines or word windows with
a Rabin-Karp polynomial over prefix sums, without a Python loop over words.

Hashes are 64-bit: ``sum(value[i] * P**i)`` over a span, shifted to the span's
start by the inverse of ``P`` modulo 2**64. Byte values go through a fixed
random table first, and results are mixed, so similar words get unrelated
hashes. They are deterministic: the same bytes hash alike in every task.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

#: Bytes that separate words: space and 0x09-0x0D. All are ASCII, so a split
#: of UTF-8 bytes equals a split of code points.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_U = np.uint64
_PRIMES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1, 0xD6E8FEB86659FD93 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection), so that near values spread."""
    x = np.asarray(x, _U).copy()
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _table(salt: int) -> np.ndarray:
    return mix(np.arange(256, dtype=_U) * _U(0x2545F4914F6CDD1D) + _U(salt * 7919 + 17)) | _U(1)


#: Byte values of the two independent hashes; ``FOLDED`` treats A-Z as a-z.
TABLES = (_table(1), _table(2))
FOLDED = TABLES[0].copy()
FOLDED[65:91] = FOLDED[97:123]


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, b, _U)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_POWERS = [Powers(p) for p in _PRIMES]


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int = 0) -> np.ndarray:
    """64-bit hash of ``values[start:end]`` for every span. ``kind`` picks one
    of the independent bases."""
    up, down = _POWERS[kind].to(len(values) + 1)
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U))


def window_hash(words: np.ndarray, size: int, kind: int = 0) -> np.ndarray:
    """Hash of every run of ``size`` consecutive word hashes (all positions,
    borders of documents included; see :func:`inside`)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    at = np.arange(n)
    return span_hash(words, at, at + size, kind)


def inside(doc: np.ndarray, size: int) -> np.ndarray:
    """True where a window of ``size`` words lies in one document."""
    n = len(doc) - size + 1
    return doc[:n] == doc[size - 1 :] if n > 0 else np.zeros(0, bool)


def blocks(column: pa.Array, max_bytes: int = 1 << 19, max_rows: int = 16384) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of whole rows of about ``max_bytes``, at
    most ``max_rows`` rows each.

    Yields ``(first_row, end_row, bytes, offsets)``; null rows are empty. A
    row longer than the limit is a run of its own, so memory follows the
    longest text.
    """
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    raw = column.buffers()
    off = np.frombuffer(raw[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1)
        hi = min(hi, n, lo + max_rows)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes outside ``gap`` that stay in one row: byte starts,
    byte ends, row of each."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    full = ~gap[data]
    head = np.empty(n, bool)
    head[0] = True
    head[1:] = ~full[:-1]
    head[offsets[:-1][offsets[:-1] < n]] = True
    tail = np.empty(n, bool)
    tail[-1] = True
    tail[:-1] = ~full[1:]
    last = offsets[1:] - 1
    tail[last[last >= 0]] = True
    starts, ends = np.flatnonzero(full & head), np.flatnonzero(full & tail) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of a value per byte (or per item) over each row."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def later_equal(key: np.ndarray) -> np.ndarray:
    """True for items equal to an earlier item."""
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    k = key[order]
    same[order[1:]] = k[1:] == k[:-1]
    return same


def text_of(table, name: str = "text"):
    """The named column of a record batch as one Arrow string array."""
    col = table.column(table.schema.get_field_index(name))
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def _give_back() -> None:
    """Return freed memory to the system: Arrow's pool and the C heap, which
    otherwise keeps the largest block's share for the worker's next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries lack it
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow kernel that gives memory back after every batch it read
    and at its end."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b
            del b
            _give_back()

    @wraps(kernel)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(read(batches))
        finally:
            _give_back()

    return run
