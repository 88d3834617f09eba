"""Token ids of whole texts by a word-level memo over a public BPE vocabulary.

The tokenizer lower-cases, splits at white space into letter runs, single digits and symbol runs, and encodes each by itself; so the
ids of a text are those of its words in turn. Texts of ASCII and the letters U+00C0-U+00FF are split as byte arrays, words are
looked up by hash, and only words not seen before go to the tokenizer. Any other text (and any
with an apostrophe, whose contractions split differently, or with the string of an added token) goes to the tokenizer as a whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ohmgraph.llm import textops

#: Closes each document.
END = 1
_LETTER, _DIGIT, _SYMBOL, _SPACE, _HIGH, _OTHER = range(1, 7)
#: Words remembered by a worker before it starts anew, and the longest one.
_SLOTS = 1 << 21
_MOST, _LONG = _SLOTS // 2, 64


def _kind(c: int) -> int:
    if c in b" \t\n\v\f\r":
        return _SPACE
    if 65 <= c <= 90 or 97 <= c <= 122:
        return _LETTER
    if 48 <= c <= 57:
        return _DIGIT
    if c == 0xC3:
        return _HIGH
    if 0x80 <= c <= 0xBF:
        return _HIGH
    return _SYMBOL if 33 <= c <= 126 and c != 39 else _OTHER


_KIND = bytes(map(_kind, range(256)))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class FastTokens:
    _own: dict[str | None, FastTokens] = {}

    @classmethod
    def shared(cls, path: str | None = None) -> FastTokens:
        """One for each worker process."""
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.full = Tokenizer.from_file(path)
        added = self.full.get_added_tokens_decoder().values()
        self.added = re.compile(b"|".join(re.escape(t.content.encode()) for t in added), re.I) if added else None
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(_SLOTS, np.uint64)
        self.at = np.zeros(_SLOTS, np.int32)
        self.n = np.zeros(_SLOTS, np.int16)
        self.ids = np.empty(1 << 20, np.uint16)
        self.used = self.words = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash; where it is not remembered, minus the empty slot for it, minus one."""
        slot = (h >> np.uint64(43)).astype(np.int64)
        out = np.empty(len(h), np.int64)
        todo = np.arange(len(h))
        while len(todo):
            s = slot[todo]
            k = self.keys[s]
            hit, free = k == h[todo], k == 0
            out[todo[hit]] = s[hit]
            out[todo[free]] = -s[free] - 1
            todo = todo[~(hit | free)]
            slot[todo] = (slot[todo] + 1) & (_SLOTS - 1)
        return out

    def _learn(self, h: np.ndarray, pieces: list[bytes]) -> None:
        ids = [self._word(word) for word in pieces]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint16, int(n.sum()))
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(len(self.ids), len(flat)), np.uint16)])
        self.ids[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(n) - n
        self.used += len(flat)
        self.words += len(h)
        todo = np.arange(len(h))
        while len(todo):
            slot, first = np.unique(-self._find(h[todo]) - 1, return_index=True)
            put = todo[first]
            self.keys[slot], self.at[slot], self.n[slot] = h[put], at[put], n[put]
            todo = np.delete(todo, first)

    def _word(self, word: bytes) -> list[int]:
        if word.isascii():
            return [t.id for t in self.full.model.tokenize(word.decode())]
        return self.full.encode(word.decode(), add_special_tokens=False).ids

    def _fast(self, data: np.ndarray, off: np.ndarray, low: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids and offsets of simple texts, END after each."""
        # kinds: letters and high letters are one kind; digits stand alone; symbols run
        edge = np.empty(len(kind) + 1, bool)
        edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        edge[0] = edge[-1] = True
        edge[off] = True
        cut = np.flatnonzero(edge)
        s, e = cut[:-1], cut[1:]
        real = kind[s] != _SPACE
        s, e = s[real], e[real]
        doc = np.searchsorted(off, s, side="right") - 1
        h = textops.hashes(low, s, e)
        h[h == 0] = 1
        if self.words > _MOST:
            self.clear()
        slot = self._find(h)
        if (new := slot < 0).any():
            fresh, first = np.unique(h[new], return_index=True)
            at = np.flatnonzero(new)[first]
            raw = low.tobytes()
            self._learn(fresh, [raw[s[i] : e[i]] for i in at])
            slot[new] = self._find(h[new])
        n = self.n[slot].astype(np.int64)
        per = np.bincount(doc, weights=n, minlength=len(off) - 1).astype(np.int64) + 1
        out_off = np.concatenate([[0], np.cumsum(per)])
        flat = np.full(out_off[-1], END, np.uint32)
        begin = np.cumsum(n) - n + doc  # one END for each text before
        total = int(n.sum())
        rel = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        flat[np.repeat(begin, n) + rel] = self.ids[np.repeat(self.at[slot].astype(np.int64), n) + rel]
        return flat, out_off

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, offsets) of runs of rows; each text's ids are followed by END."""
        for a, b, data, off in textops.chunks(column, 1 << 19):
            raw = data.tobytes()
            low = np.frombuffer(raw.translate(_LOWER), np.uint8)
            kind = np.frombuffer(bytearray(raw.translate(_KIND)), np.uint8)
            bad = kind == _OTHER
            high = kind == _HIGH
            if high.any():
                lead = data == 0xC3
                second = np.zeros(len(data), bool)
                second[1:] = lead[:-1]
                second &= high & ~lead
                bad = bad | (high & ~(lead | second))
                low = low.copy()
                i = np.flatnonzero(second)
                c = data[i]
                upper = (c >= 0x80) & (c <= 0x9E) & (c != 0x97)
                low[i[upper]] += 0x20
                kind[high] = _LETTER
                sign = i[(c == 0x97) | (c == 0xB7)]
                kind[sign] = kind[sign - 1] = _SYMBOL
            if not bad.any() and np.diff(off).max(initial=0) < 1 << 26:
                simple = np.ones(b - a, bool)
            else:
                simple = np.ones(b - a, bool)
                simple[np.searchsorted(off, np.flatnonzero(bad), side="right") - 1] = False
            if self.added is not None:  # the tokenizer takes these strings out of a text before it splits the rest
                for m in self.added.finditer(raw):
                    simple[np.searchsorted(off, m.start(), side="right") - 1] = False
            # words that are too long to remember
            cutted = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1], [True]])) if len(kind) else np.zeros(1, int)
            long = (np.diff(cutted) > _LONG) & (kind[cutted[:-1]] != _SPACE) if len(kind) else np.zeros(0, bool)
            if long.any():
                simple[np.searchsorted(off, cutted[:-1][long], side="right") - 1] = False
            if simple.all():
                yield a, b, *self._fast(data, off, low, kind)
                continue
            for i in range(b - a):
                x, y = int(off[i]), int(off[i + 1])
                if simple[i]:
                    yield a + i, a + i + 1, *self._fast(data[x:y], np.array([0, y - x]), low[x:y], kind[x:y])
                else:
                    ids = np.array([*self.full.encode(raw[x:y].decode(), add_special_tokens=False).ids, END], np.uint32)
                    yield a + i, a + i + 1, ids, np.array([0, len(ids)])
