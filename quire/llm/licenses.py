"""Licence scans: winnowed template fingerprints, then banded alignment.

Templates (a small, size-checked dictionary) are cut into word grams; of every
``window`` neighbouring grams the one with the smallest hash is kept, and the
kept grams form an inverted index hash -> (template, position). Every gram of
every document is looked up. Hits of one template on neighbouring diagonals
(document position minus template position) make a candidate, which is aligned
with the template inside a band around that diagonal. Matches report the share
of template words that were aligned and the span of code points in the text.
One-line notices that overlap compete, as do GNU headers: the best stays.

The dictionary holds the reserved-rights line; notices of Apache 2.0, MIT, BSD,
ISC, MPL 2.0, GPL 2 and 3, LGPL 2.1 and 3, AGPL 3, CC BY (and SA, ND, NC, NC-SA,
NC-ND) 4.0 and CC0; headers of Apache, MPL and the GNU licences; whole texts of
MIT, BSD (2 and 3 clauses), ISC, Unlicense, Apache 2.0, GPL 2 and 3, LGPL 2.1
and 3, MPL 2.0 and CC0. Others (whole AGPL and CC BY texts, older versions,
other wordings) are not found.

One scan, no shuffle; the index travels with the task, bounded by
``max_template_words``. Words are runs of letters, digits and non-ASCII
characters, compared without ASCII case.

Defined results for odd input: null, empty and wordless texts have no matches;
a null ``doc_id`` keeps its matches; repeated rows match alike, each by itself;
a template shorter than one gram is matched as one gram of its own length; an
empty table, or no templates, gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import wordhash as wh
from quire.session import ship_package

_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License "
    "as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution. {}"
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, '
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without '
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
)
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS '

#: Notices, headers and short bodies of common licences, as they
#: stand in files. Long bodies are in ``license_texts``.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "mit-notice": "Released under the MIT License.",
    "mit-grant": _MIT,
    "mit-license": _MIT + (
        ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS +
        "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "bsd-notice": "Released under the BSD License.",
    "bsd-2-clause-license": _BSD.format(""),
    "bsd-3-clause-license": _BSD.format(
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission. "
    ),
    "isc-notice": "Released under the ISC License.",
    "isc-license": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR "
        "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
        "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
        "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
        "THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "mpl-2.0-notice": "Licensed under the Mozilla Public License, Version 2.0.",
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "gpl-2.0-header": _GNU.format("", "2"),
    "gpl-3.0-header": _GNU.format("", "3"),
    "lgpl-2.1-header": _GNU.format("Lesser ", "2.1"),
    "lgpl-3.0-header": _GNU.format("Lesser ", "3"),
    "agpl-3.0-header": _GNU.format("Affero ", "3"),
    **{f"cc-{x.lower()}-4.0-notice": f"Licensed under CC {x} 4.0." for x in ("BY", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND")},
    "cc0-1.0-notice": "Licensed under CC0 1.0.",
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate "
        "any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large "
        "and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of "
        "all present and future rights to this software under copyright law. " + _AS_IS +
        "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR "
        "IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
}


def production_templates() -> dict[str, str]:
    """``TEMPLATES`` and the full texts beside this module, read on the driver."""
    folder = Path(__file__).parent / "license_texts"
    return TEMPLATES | {f"{p.stem}-text": p.read_text() for p in sorted(folder.glob("*.txt"))}


def _family(name: str) -> str:
    """Templates that differ by a word or two compete for a span."""
    if name.endswith("-notice"):
        return "notice"
    return "gnu-header" if re.fullmatch(r"[al]?gpl-.*-header", name) else name


_GAP = np.ones(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _GAP[_a:_b] = False


@dataclass(frozen=True)
class Index:
    """Winnowed grams sorted by hash, and every template's word hashes."""

    names: tuple
    words: tuple
    hash: np.ndarray
    template: np.ndarray
    position: np.ndarray
    need: np.ndarray
    gram: np.ndarray


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, doc = wh.spans(data, off, _GAP)
    return starts, ends, doc, wh.span_hash(wh.FOLDED[data], starts, ends)


def build_index(templates: dict[str, str], gram: int = 3, window: int = 3, min_share: float = 0.25, max_template_words: int = 1_000_000) -> Index:
    """The index of ``templates``. ``min_share`` of a template's kept grams
    must hit on one diagonal band to make a candidate."""
    names, words, rows = [], [], []
    for name, text in sorted(templates.items()):
        data = np.frombuffer(text.encode(), np.uint8)
        _, _, _, w = _words(data, np.array([0, len(data)]))
        if not len(w):
            continue
        g = min(gram, len(w))
        h = wh.window_hash(w, g)
        keep = sorted({i + int(np.argmin(h[i : i + window])) for i in range(max(1, len(h) - window + 1))})
        rows += [(int(h[i]), len(names), i, g) for i in keep]
        names.append(name)
        words.append(w)
    if sum(map(len, words)) > max_template_words:
        raise ValueError(f"templates hold more than {max_template_words} words; they travel with every task")
    rows.sort()
    col = lambda k, t: np.array([r[k] for r in rows], t)
    template = col(1, np.int64)
    kept = np.bincount(template, minlength=len(names))
    return Index(tuple(names), tuple(words), col(0, np.uint64), template, col(2, np.int64), np.maximum(1, np.ceil(min_share * kept)).astype(int), col(3, np.int64))


def align(words: np.ndarray, template: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int, int]:
    """Best local alignment near a diagonal: (score, matched template words,
    first document word, end word). A match earns 2; a mismatch or a skipped
    word costs 1. Rows are template words, columns the band of diagonals."""
    width = 2 * band + 1
    col = np.arange(width)
    none = -(10**6)
    score, match, first = np.zeros(width, int), np.zeros(width, int), np.full(width, -1)
    best = (0, 0, 0, 0)
    for i in range(len(template)):
        at = i + diagonal - band + col
        ok = (at >= 0) & (at < len(words))
        same = ok & (words[np.clip(at, 0, max(len(words) - 1, 0))] == template[i])
        fresh = score <= 0
        s = np.where(ok, np.where(fresh, 0, score) + np.where(same, 2, -1), none)
        m = np.where(fresh, 0, match) + same
        f = np.where(fresh | (first < 0), at, first)
        # skip a template word: the cell one diagonal further on
        up = np.append(score[1:], none) - 1
        take = up > s
        s, m, f = np.where(take, up, s), np.where(take, np.append(match[1:], 0), m), np.where(take, np.append(first[1:], -1), f)
        # skip document words: the best cell to the left, less the distance
        lifted = np.maximum.accumulate(s + col)
        origin = np.maximum.accumulate(np.where(s + col == lifted, col, 0))
        s, m, f = lifted - col, m[origin], f[origin]
        score, match, first = s, m, f
        j = int(np.argmax(s))
        if s[j] > best[0]:
            best = (int(s[j]), int(m[j]), int(f[j]), int(at[j]) + 1)
    return best


_SCHEMA = "doc_id long, template string, coverage double, matched long, template_words long, start long, end long"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, gram: int = 3, window: int = 3, band: int = 8, min_coverage: float = 0.8) -> DataFrame:
    """One row per match: doc_id, template, coverage (share of the template's
    words aligned), matched and template words, start and end code points."""
    index = build_index(production_templates() if templates is None else templates, gram, window)
    families = [_family(x) for x in index.names]
    # two notices of one template lie at least its length apart
    bands = np.array([min(band, max(1, len(w) // 4)) for w in index.words], int)

    def matches(words: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, template, matched, first word, end word), words of the block."""
        found = []
        for g in np.unique(index.gram):
            mine = index.gram == g
            h = wh.window_hash(words, int(g))
            at = np.flatnonzero(wh.inside(doc, int(g)))
            lo = np.searchsorted(index.hash[mine], h[at], "left")
            n = np.searchsorted(index.hash[mine], h[at], "right") - lo
            total = np.concatenate([[0], np.cumsum(n)])
            entry = np.repeat(lo - total[:-1], n) + np.arange(total[-1])
            found.append((np.repeat(at, n), index.template[mine][entry], index.position[mine][entry]))
        at, t, p = (np.concatenate(x) for x in zip(*found))
        if not len(at):
            return
        slot = (at - p) // bands[t]
        order = np.lexsort((p, slot, t))
        at, t, p, slot = at[order], t[order], p[order], slot[order]
        row = doc[at]
        cut = np.flatnonzero((t[1:] != t[:-1]) | (slot[1:] != slot[:-1]) | (row[1:] != row[:-1])) + 1
        border = np.searchsorted(doc, np.arange(doc[-1] + 2))
        hits = []
        first_hit, end_hit = np.append(0, cut), np.append(cut, len(at))
        enough = end_hit - first_hit >= index.need[t[first_hit]]
        for s, e in zip(first_hit[enough], end_hit[enough]):
            k, r = int(t[s]), int(row[s])
            if len(np.unique(p[s:e])) < index.need[k]:
                continue
            a, b = border[r], border[r + 1]
            score, m, first, end = align(words[a:b], index.words[k], int(np.median(at[s:e] - p[s:e])) - int(a), int(bands[k] + bands[k] // 2))
            if m >= min_coverage * len(index.words[k]):
                hits.append((-score, r, k, m, first + int(a), end + int(a)))
        taken: dict[tuple[int, str], list[tuple[int, int]]] = {}
        for _, r, k, m, a, b in sorted(hits):  # the best of those that overlap
            spans = taken.setdefault((r, families[k]), [])  # disjoint, by start
            i = bisect_left(spans, (a, b))
            if (i == 0 or spans[i - 1][1] <= a) and (i == len(spans) or b <= spans[i][0]):
                spans.insert(i, (a, b))
                yield r, k, m, a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.float64()] + [pa.int64()] * 4
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        for b in batches:
            ids = b.column(0)
            for lo, _, data, off in wh.blocks(wh.text_of(b)):
                starts, ends, doc, words = _words(data, off)
                if not len(words) or not len(index.hash):
                    continue
                found = list(matches(words, doc))
                if found:  # code points before each byte, counted once for the block
                    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                out = []
                for r, k, m, a, e in found:
                    n = len(index.words[k])
                    start, end = (int(points[x] - points[off[r]]) for x in (starts[a], ends[e - 1]))
                    out.append((ids[lo + r].as_py(), index.names[k], m / n, m, n, start, end))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SCHEMA)
