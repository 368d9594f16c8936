"""Token ids of whole texts with a public tokenizer file, word by word.

The tokenizer of ``word_bpe_49k.json`` lower-cases, drops white space and
never merges across it, so a text's ids are the ids of its pieces in order.
:class:`WordEncoder` finds the pieces of a whole Arrow batch with numpy,
encodes each distinct piece once per worker and gathers the ids of all texts
by index. The memo is a sorted array of piece hashes beside the pieces' ids; it
is bounded by ``max_pieces`` and starts anew beyond it.

Pieces are runs between ASCII white space, cut further where a Latin-1 letter
meets ASCII punctuation or a digit (never at an apostrophe). The tokenizer's
own pattern cuts there too, and neither normalisation nor a merge crosses such
a border. Latin-1 capitals are lowered first, as the tokenizer would. Where a
batch holds ``<|``, which may open a special token, pieces are whole words and
keep their case.
"""

from __future__ import annotations

from itertools import chain

import numpy as np

from quire.llm import wordhash as wh

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = True
_LETTER[97:123] = True
_MARK = np.zeros(256, bool)  # ASCII that is neither letter, space nor apostrophe
_MARK[33:65] = True
_MARK[91:97] = True
_MARK[123:127] = True
_MARK[39] = False
#: Second bytes of the Latin-1 letters, which all follow 0xC3 (not the signs
#: for times and divided by).
_TAIL = np.zeros(256, bool)
_TAIL[0x80:0xC0] = True
_TAIL[[0x97, 0xB7]] = False
#: The byte-level alphabet: printable bytes stand for themselves, the others
#: for the code points from 256 on, in order.
_PRINTS = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in set(_PRINTS))}


def default_tokenizer() -> str:
    """Path of the packaged vocabulary on this machine; resolved in the task,
    so driver and executors may keep it in different places."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Encodes Arrow blocks with the tokenizer file at ``path``."""

    def __init__(self, path: str | None = None, max_pieces: int = 500_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path or default_tokenizer())
        self.model, self.norm, self.split = self.tok.model, self.tok.normalizer, self.tok.pre_tokenizer
        self.size = self.tok.get_vocab_size()
        self.max_pieces = max_pieces
        self.cased = False
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.slot = np.zeros(0, np.int32)
        self.at = np.zeros(1024, np.int64)
        self.len = np.zeros(1024, np.int32)
        self.pool = np.zeros(4096, np.uint32)
        self.used = 0

    def _ids(self, piece: bytes) -> list[int]:
        if piece.isalpha() and piece.islower():  # ASCII letters: one word of the vocabulary's pattern
            return [t.id for t in self.model.tokenize(piece.decode())]
        text = piece.decode("utf-8", "replace")
        if text.isalpha() and text.islower() and max(text) <= "\xff" and not self.cased:
            return [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(_ALPHABET))]
        if "<|" in text:
            return self.tok.encode(text, add_special_tokens=False).ids
        return [t.id for part, _ in self.split.pre_tokenize_str(self.norm.normalize_str(text)) for t in self.model.tokenize(part)]

    def _remember(self, keys: np.ndarray, found: list[list[int]]) -> None:
        """Add new pieces, in the order of their keys."""
        old, n = len(self.keys), len(keys)
        sizes = np.fromiter(map(len, found), np.int64, n)
        while old + n > len(self.at):
            self.at, self.len = (np.concatenate([x, np.zeros(len(x), x.dtype)]) for x in (self.at, self.len))
        while self.used + sizes.sum() > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        end = self.used + np.cumsum(sizes)
        self.pool[self.used : self.used + sizes.sum()] = np.fromiter(chain.from_iterable(found), np.uint32)
        self.at[old : old + n], self.len[old : old + n] = end - sizes, sizes
        self.used += int(sizes.sum())
        spot = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, spot, keys)
        self.slot = np.insert(self.slot, spot, np.arange(old, old + n, dtype=np.int32))

    def _slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of sorted keys in the memo, and which of them are there."""
        spot = np.searchsorted(self.keys, keys)
        known = spot < len(self.keys)
        known[known] = self.keys[spot[known]] == keys[known]
        return spot, known

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a block, one after the other, and row borders."""
        rows = len(off) - 1
        starts, ends, doc = wh.spans(data, off)
        raw = data.tobytes()
        special = self.cased = b"<|" in raw
        if not special and len(data) > 1:
            data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
            tail = np.zeros(len(data), bool)
            tail[1:] = (data[:-1] == 0xC3) & _TAIL[data[1:]]
            data += (tail & (data < 0x9F)).astype(np.uint8) * np.uint8(32)
            last = _LETTER[data] | tail
            first = _LETTER[data]
            first[:-1] |= tail[1:]
            mark = _MARK[data]
            edge = (last[:-1] & mark[1:]) | (mark[:-1] & first[1:])
            edge[off[(off > 0) & (off < len(data))] - 1] = False  # rows are cut already
            cut = np.flatnonzero(edge) + 1
            starts = np.sort(np.concatenate([starts, cut]))
            ends = np.sort(np.concatenate([ends, cut]))
            doc = np.searchsorted(off, starts, "right") - 1
            raw = data.tobytes()
        key = wh.span_hash(wh.TABLES[0][data], starts, ends)
        if special:
            key = wh.mix(key + np.uint64(1))
        distinct, at, where = np.unique(key, return_index=True, return_inverse=True)
        known = self._slots(distinct)[1]
        if not known.all():
            if len(self.keys) + int((~known).sum()) > self.max_pieces:
                self.clear()
                known[:] = False
            new = at[~known]
            self._remember(distinct[~known], [self._ids(raw[a:b]) for a, b in zip(starts[new].tolist(), ends[new].tolist())])
        at = self.slot[self._slots(distinct)[0]][where] if len(distinct) else np.zeros(0, np.int32)
        n = self.len[at].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.pool[np.repeat(self.at[at] - total[:-1], n) + np.arange(total[-1])]
        return ids, total[np.searchsorted(doc, np.arange(rows + 1))]


_ENCODERS: dict[str | None, WordEncoder] = {}


def encoder(path: str | None) -> WordEncoder:
    """The worker's encoder of this file, loaded once per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
