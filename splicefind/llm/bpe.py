"""Whole-text BPE encoding through the tokenizers library, with a per-worker cache of units.

Both vocabularies first cut a text into pre-tokens that never depend on what lies beyond a
white-space boundary, so a text's ids are those of its units end to end.  A unit is a
run of letters, of digits or of other signs; runs with an apostrophe or with characters
outside ASCII and Latin letters stay whole, and a text with white space beyond ASCII or
with the literal text of an added token is encoded whole.  Each new unit is encoded by the
library once and then looked up by its 64-bit hash; every occurrence is held against the
cached unit byte by byte, and one that differs is encoded on its own.  The cache is
emptied at ``MOST_UNITS``, which bounds it and changes no id.
"""

from __future__ import annotations

import os

import numpy as np

from . import textvec as tv

MOST_UNITS = 1_500_000
SPACE, BLANK, LETTER, DIGIT, OTHER, WHOLE = range(6)

_CLASS = np.full(256, WHOLE, dtype=np.uint8)
_CLASS[0x21:0x7F] = OTHER
_CLASS[0x27] = WHOLE  # the apostrophe starts contractions
_CLASS[0x30:0x3A] = DIGIT
_CLASS[0x41:0x5B] = LETTER
_CLASS[0x61:0x7B] = LETTER
_CLASS[0x80:0xC0] = LETTER  # continuation bytes go with their lead
_CLASS[0xC3:0xC6] = LETTER  # U+00C0..U+017F but for two signs, see below
_CLASS[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = BLANK
_CLASS[0x20] = SPACE

_encoders: dict[tuple[str, bool], UnitEncoder] = {}


def encoder(path: str, spaced: bool) -> UnitEncoder:
    """The worker's encoder of a vocabulary file; ``spaced``: a space belongs to the word after it."""
    if (path, spaced) not in _encoders:
        _encoders[path, spaced] = UnitEncoder(path, spaced)
    return _encoders[path, spaced]


def _odd_space(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Texts with white space (or what might be) beyond ASCII."""
    lead = np.flatnonzero((buf == 0xC2) | ((buf >= 0xE1) & (buf <= 0xE3)) | ((buf >= 0x1C) & (buf <= 0x1F)))
    if not len(lead):
        return np.zeros(len(offs) - 1, dtype=bool)
    a, b = buf[lead], np.append(buf, [0, 0])[lead + 1]
    odd = (a < 0x20) | ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80))
    out = np.zeros(len(offs) - 1, dtype=bool)
    out[np.searchsorted(offs, lead[odd], side="right") - 1] = True
    return out


class UnitEncoder:
    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.literals = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = spaced
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, tv.U64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint32)
        self.text_at, self.text_size, self.text = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def units(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte ranges of the units, in order; with ``spaced`` they cover every byte."""
        cls = _CLASS[buf]
        n = len(buf)
        begins = np.zeros(n + 1, dtype=bool)
        begins[offs] = True
        sign = np.flatnonzero(buf == 0xC3)
        sign = sign[np.isin(np.append(buf, 0)[sign + 1], (0x97, 0xB7))]
        cls[sign] = WHOLE
        blank = cls <= BLANK
        before = np.empty(n, dtype=bool)
        before[0], before[1:] = True, blank[:-1]
        before |= begins[:n]
        run = ~blank & before
        change = np.zeros(n, dtype=bool)
        change[1:] = (cls[1:] != cls[:-1]) & ~blank[1:] & ~blank[:-1] & ~begins[1:n]
        if (cls == WHOLE).any():
            first = np.flatnonzero(run)
            odd = np.add.reduceat((cls == WHOLE).astype(np.int32), first) > 0
            change &= ~np.repeat(odd, np.diff(np.append(first, n)))[: n - first[0]] if first[0] == 0 else ~np.concatenate([np.zeros(first[0], bool), np.repeat(odd, np.diff(np.append(first, n)))])
        if not self.spaced:
            start = run | change
            nxt = np.ones(n + 1, dtype=bool)
            nxt[:n] = blank | start | begins[:n]
            return np.flatnonzero(start), np.flatnonzero(~blank & nxt[1:]) + 1
        start = change
        start |= begins[:n]
        start[1:] |= blank[1:] & ~blank[:-1]
        at = np.flatnonzero(run)
        inner = at[~begins[at]]  # the blank before a word: a unit of its own, or the word's first byte
        start[inner - 1] = True
        start[inner[buf[inner - 1] != 0x20]] = True
        starts = np.flatnonzero(start)
        return starts, np.append(starts[1:], n)

    def library(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each unit, all ids) from the library."""
        got = self.tokenizer.encode_batch_fast([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist())], add_special_tokens=False)
        ids = [x.ids for x in got]
        size = np.fromiter((len(x) for x in ids), dtype=np.int32, count=len(ids))
        return size, np.fromiter((i for x in ids for i in x), dtype=np.uint32, count=int(size.sum()))

    def learn(self, keys: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        size, ids = self.library(buf.tobytes(), starts, ends)
        at = np.cumsum(size) - size + len(self.flat)
        self.flat = np.concatenate([self.flat, ids])
        long = ends - starts
        text_at = np.cumsum(long) - long + len(self.text)
        self.text = np.concatenate([self.text, buf[np.arange(int(long.sum())) + np.repeat(starts - (np.cumsum(long) - long), long)]])
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = np.insert(self.keys, where, keys), np.insert(self.at, where, at), np.insert(self.size, where, size)
        self.text_at, self.text_size = np.insert(self.text_at, where, text_at), np.insert(self.text_size, where, long)

    def differs(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Which occurrences are not the bytes of their cached unit."""
        long, at = ends - starts, self.text_at[unit]
        out = long != self.text_size[unit]
        here, there = tv.lanes(buf), tv.lanes(self.text)
        out |= ((here[starts] ^ there[at]) & tv.inside(long)) != 0
        rest = np.flatnonzero(~out & (long > 8))
        step = 8
        while len(rest):
            left = long[rest] - step
            out[rest] = ((here[starts[rest] + step] ^ there[at[rest] + step]) & tv.inside(left)) != 0
            rest = rest[~out[rest] & (left > 8)]
            step += 8
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[i] == keys, i, -1)

    def plain(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        w = tv.Words.__new__(tv.Words)
        w.buf = buf
        w.starts, w.ends = self.units(buf, offs)
        keys, first, inverse = np.unique(w.hashes(), return_index=True, return_inverse=True)
        found = self.find(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            if len(self.keys) + len(new) > MOST_UNITS:  # learn() will empty the cache: all are new then
                self.clear()
                new = np.arange(len(keys))
            self.learn(keys[new], buf, w.starts[first[new]], w.ends[first[new]])
            found = self.find(keys)
        unit = found[inverse]
        size, at, flat = self.size[unit], self.at[unit], self.flat
        other = np.flatnonzero(self.differs(buf, w.starts, w.ends, unit))
        if len(other):  # units of one hash
            more, ids = self.library(buf.tobytes(), w.starts[other], w.ends[other])
            size[other], at[other] = more, np.cumsum(more) - more + len(flat)
            flat = np.concatenate([flat, ids])
        begin = np.cumsum(size, dtype=np.int64) - size
        ids = flat[np.arange(int(size.sum(dtype=np.int64))) + np.repeat(at - begin, size)]
        return ids, tv.sum_by(np.searchsorted(w.starts, offs), size)

    def literal(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Texts that hold the literal text of an added token."""
        raw, out = buf.tobytes(), np.zeros(len(offs) - 1, dtype=bool)
        for token in self.literals:
            at = raw.find(token)
            while at >= 0:
                out[np.searchsorted(offs, at, side="right") - 1] = True
                at = raw.find(token, at + 1)
        return out

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block end to end, and where each text's ids start."""
        odd = _odd_space(buf, offs) | self.literal(buf, offs)
        if not odd.any():
            ids, size = self.plain(buf, offs)
            return ids, np.concatenate([[0], np.cumsum(size)])
        lens = np.diff(offs)
        lens[odd] = 0
        kept = np.repeat(~odd, np.diff(offs))
        ids, size = self.plain(buf[kept], np.concatenate([[0], np.cumsum(lens)]))
        of = np.concatenate([[0], np.cumsum(size)])
        raw = buf.tobytes()
        parts = [np.array(self.tokenizer.encode(raw[offs[i] : offs[i + 1]].decode("utf-8", "replace"), add_special_tokens=False).ids, dtype=np.uint32) if odd[i] else ids[of[i] : of[i + 1]] for i in range(len(odd))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def with_end(ids: np.ndarray, of: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with one end id after each text."""
    return np.insert(ids, of[1:], np.uint32(end)), of + np.arange(len(of))
