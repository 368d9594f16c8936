"""Fill-in-middle examples, with cuts located through memoised chunks.

A text's units are runs of ASCII letters and single other code points. Two
seeded numbers of the document cut the unit sequence into prefix, middle and
suffix, which are put in the order prefix-suffix-middle or
suffix-prefix-middle, or left as they are.

Units are counted by content-defined chunks: a rolling hash over the last
``WINDOW`` bytes of a row ends a chunk wherever its low bits are zero, so equal
passages fall into equal chunks wherever they stand. A chunk's boundary
summary (units, code points, whether it begins and ends in a letter) is kept
under its fingerprint and used again only after the bytes have been compared.
Summaries combine: a letter run that crosses a border is one unit, not two. A
cut is located by searching the running unit counts for its chunk, and only
that chunk is read again.

One scan, no shuffle; rows are independent, so no key can be hot. The memo
belongs to a task and holds at most ``memo_bytes`` of chunks, then starts anew;
chunks over ``LONGEST`` bytes are summarised but not kept.

Defined results for odd input: a null text is empty; an empty text, or one
that holds a mark of the format, stays plain; a null ``doc_id`` is hashed as
the empty string; repeated rows give equal results; an empty table gives an
empty result; extra columns are ignored. Whole texts are used.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import wordhash as wh
from quire.session import ship_package

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARK = re.compile(rb"<[PSM]>")
#: A unit in UTF-8 bytes: letters, or one code point.
UNIT = re.compile(rb"[A-Za-z]+|[^A-Za-z\x80-\xbf][\x80-\xbf]*")
WINDOW, BITS, LONGEST = 16, 8, 1 << 16
_LETTER = frozenset(range(65, 91)) | frozenset(range(97, 123))


def chunk_borders(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sorted chunk borders of a block of rows (bytes and row offsets): the
    rows' own borders, and places after a window whose rolling hash ends in
    zeros. A place depends on the ``WINDOW`` bytes before it alone; a run of
    one byte has no inner border, and no border cuts a code point."""
    n = len(data)
    rows = np.unique(off)
    if n <= WINDOW:
        return rows
    at = np.arange(n - WINDOW + 1)
    h = wh.span_hash(wh.TABLES[0][data], at, at + WINDOW)
    cut = (h & np.uint64((1 << BITS) - 1)) == 0
    cut[1:] &= h[1:] != h[:-1]
    end = np.flatnonzero(cut) + WINDOW
    row = np.searchsorted(off, end, "left") - 1  # the row that holds the window's last byte
    end = end[(end - WINDOW >= off[row]) & (end < n)]
    end = end[(data[end] & 0xC0) != 0x80]
    return np.union1d(rows, end)


class ChunkMemo:
    """Boundary summaries of chunks: (units, code points, begins with a
    letter, ends with a letter)."""

    def __init__(self, memo_bytes: int = 32 << 20):
        self.limit, self.used, self.hits = memo_bytes, 0, 0
        self.kept: dict[int, tuple[bytes, tuple[int, int, bool, bool]]] = {}

    @staticmethod
    def read(chunk: bytes) -> tuple[int, int, bool, bool]:
        return len(UNIT.findall(chunk)), len(chunk.decode("utf-8", "replace")), chunk[0] in _LETTER, chunk[-1] in _LETTER

    def summary(self, fingerprint: int, chunk: bytes) -> tuple[int, int, bool, bool]:
        known = self.kept.get(fingerprint)
        if known is not None and known[0] == chunk:
            self.hits += 1
            return known[1]
        found = self.read(chunk)
        if known is None and len(chunk) <= LONGEST:
            if self.used + len(chunk) > self.limit:
                self.kept.clear()
                self.used = 0
            self.kept[fingerprint] = (chunk, found)
            self.used += len(chunk)
        return found


class UnitIndex:
    """Unit counts of the rows of one block, from the chunks' summaries."""

    def __init__(self, data: np.ndarray, off: np.ndarray, memo: ChunkMemo):
        self.raw, self.off = data.tobytes(), off
        border = chunk_borders(data, off)
        self.start, self.end = border[:-1], border[1:]
        prints = wh.span_hash(wh.TABLES[1][data], self.start, self.end, 1).tolist() if len(data) else []
        found = [memo.summary(f, self.raw[a:b]) for f, a, b in zip(prints, self.start.tolist(), self.end.tolist())]
        units, chars, head, tail = (np.array(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 4
        self.joined = np.zeros(len(units), bool)  # the first unit began in the chunk before
        self.joined[1:] = head[1:].astype(bool) & tail[:-1].astype(bool) & ~np.isin(self.start[1:], off)
        total = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
        self.units, self.chars = total(units - self.joined), total(chars)  # units that begin, code points before each chunk
        self.first = np.searchsorted(self.start, off)  # first chunk of each row

    def n_units(self, row: int) -> int:
        return int(self.units[self.first[row + 1]] - self.units[self.first[row]])

    def locate(self, row: int, k: int) -> tuple[int, int]:
        """Byte and code point in the row after its first ``k`` units."""
        a, b = self.first[row], self.first[row + 1]
        at = self.units[a] + k
        if at >= self.units[b]:
            return int(self.off[row + 1] - self.off[row]), int(self.chars[b] - self.chars[a])
        c = int(np.searchsorted(self.units, at, "right")) - 1  # the chunk in which unit k begins
        skip = int(at - self.units[c] + self.joined[c])
        chunk = self.raw[self.start[c] : self.end[c]]
        inside = 0
        for no, m in enumerate(UNIT.finditer(chunk)):
            if no == skip:
                inside = m.start()
                break
        points = int(self.chars[c] - self.chars[a]) + len(chunk[:inside].decode("utf-8", "replace"))
        return int(self.start[c] - self.off[row]) + inside, points


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, memo_bytes: int = 32 << 20) -> DataFrame:
    """One row per document: doc_id, n units, form (plain, psm, spm), code
    points of prefix and middle (null if plain) and the output text."""
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = ChunkMemo(memo_bytes)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        for b in batches:
            ids = b.column(0).to_pylist()
            for lo, hi, data, off in wh.blocks(wh.text_of(b)):
                index = UnitIndex(data, off, memo)
                rows, texts = [], []
                for r in range(hi - lo):
                    text, n = index.raw[off[r] : off[r + 1]], index.n_units(r)
                    h1, h2, h3, h4 = draws(ids[lo + r], seed)
                    if not text or h3 % 100 >= 100 - plain_percent or _MARK.search(text):
                        rows.append((ids[lo + r], n, "plain", None, None))
                        texts.append(text)
                        continue
                    one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
                    (x, cx), (y, cy) = index.locate(r, one), index.locate(r, two)
                    form = "spm" if h4 % 100 < spm_percent else "psm"
                    rows.append((ids[lo + r], n, form, cx, cy - cx))
                    head = (s, text[y:], p, text[:x]) if form == "spm" else (p, text[:x], s, text[y:])
                    texts.append(b"".join((*head, m, text[x:y])))
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                out = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*columns, out], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. Plain texts may hold marks, the
    others hold each mark once, as the format puts it."""
    part = lambda i: F.get(F.split(output, "<[PSM]>", -1), F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
