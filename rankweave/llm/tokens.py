"""Byte-level BPE ids of whole texts, with the ids of words kept between texts.

The pre-tokenizer of the vocabulary never lets a token cross from a non-white character into a
white one.  So a text may be cut before any space or line feed that follows a non-white
character, and the ids of the parts, encoded alone, are the ids of the text.  Most parts are
words met before; they are found by a 64-bit hash of their bytes and compared by length and by
their first and last eight bytes (all of a word of up to 16; a longer one would have to share
those and its hash with another).  Only new ones go through the tokenizers library, many in one
string: the ids' byte lengths tell where each part ends.  A text with a word that hashes like
another is encoded whole.
Texts with other white space than single spaces and line feeds between words are encoded whole.
"""

from __future__ import annotations

import os
from functools import cache

import numpy as np

from . import words as W

END_ID = 2
_CASED = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.zeros(256, bool)  # control characters
_ODD[:32] = _ODD[127] = True
_ODD[10] = False
_GAP = np.zeros(256, bool)
_GAP[[10, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[44, 46]] = True


def _hash(run: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return W.mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))


def _ends(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """First and last eight bytes (or as many as there are) and length of each span."""
    wide = np.concatenate([np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(wide) - 7, "<u8", wide, strides=(1,))
    size = end - start
    spare = (8 * np.maximum(8 - size, 0)).astype(np.uint64)
    return np.column_stack([eight[start + 8] << spare, eight[end] >> spare << spare, size.astype(np.uint64)])


def irregular(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which texts hold white space other than single spaces and line feeds between words, or control characters."""
    n = len(data)
    bad = _ODD[data]
    gap = _GAP[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    bad[1:] |= gap[1:] & gap[:-1]
    bad |= gap & (edge[:-1] | edge[1:])  # first or last
    lead = np.flatnonzero((data == 0xC2) | (data >= 0xE1) & (data <= 0xE3))
    if len(lead):  # U+0085, U+00A0, and the white characters of three bytes
        one = data[np.minimum(lead + 1, n - 1)].astype(np.int32)
        two = data[np.minimum(lead + 2, n - 1)].astype(np.int32)
        code = np.where(data[lead] == 0xC2, one, ((data[lead].astype(np.int32) & 15) << 12) | ((one & 63) << 6) | (two & 63))
        bad[lead[np.isin(code, [0x85, 0xA0, 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]] = True
    where = np.flatnonzero(bad)
    return np.searchsorted(where, at[1:]) > np.searchsorted(where, at[:-1])


class _Slots:
    """Numbers of 64-bit keys in an open-addressed table, found and added by whole arrays."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.keys, self.vals = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 if it has none."""
        out = np.full(len(keys), -1, np.int64)
        at, left = (keys >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(keys))
        while len(left):
            val = self.vals[at]
            own = self.keys[at] == keys[left]
            hit = own & (val >= 0)
            out[left[hit]] = val[hit]
            on = ~own & (val >= 0)
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, keys: np.ndarray) -> None:
        """Number new distinct keys from the last one on."""
        if 5 * (self.n + len(keys)) > 3 << self.bits:  # at most three fifths full
            old = np.flatnonzero(self.vals >= 0)
            kept = self.keys[old[np.argsort(self.vals[old])]]
            n = self.n + len(keys)
            while 5 * n > 3 << self.bits:
                self.bits += 1
            self.keys, self.vals, self.n = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32), 0
            self.add(kept)
        at, left = (keys >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = self.vals[at] < 0
            _, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[at[won]], self.vals[at[won]] = keys[left[won]], self.n + left[won]
            on = np.ones(len(left), bool)
            on[won] = False
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        self.n += len(keys)


class Encoder:
    """Ids of texts.  ``keep`` bounds the remembered words; beyond it the memory starts anew."""

    def __init__(self, path: str, keep: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.keep = Tokenizer.from_file(path), keep
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for word, i in vocab.items():
            self.bytes[i] = len(word)  # one character of the byte alphabet a byte
        self.marks = {m: np.array(self.tok.encode(chr(m), add_special_tokens=False).ids, np.int32) for m in (44, 46)}
        self.forget()

    def forget(self) -> None:
        self.slot = _Slots()
        self.flat = np.zeros(1 << 16, np.int32)
        self.at = np.zeros(1 << 14, np.int64)
        self.ends = np.zeros((1 << 14, 3), np.uint64)

    def _add(self, keys: np.ndarray, ends_of: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        n, first = self.slot.n, int(self.at[self.slot.n])
        ends = first + np.cumsum(sizes)
        while len(self.at) <= n + len(keys):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while len(self.flat) < ends[-1]:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.at[n + 1 : n + 1 + len(keys)] = ends
        self.ends[n : n + len(keys)] = ends_of
        self.flat[first : ends[-1]] = flat
        self.slot.add(keys)

    def _gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each slot, and all their ids end to end."""
        size = self.at[slots + 1] - self.at[slots]
        ends = np.cumsum(size)
        return size, self.flat[np.arange(ends[-1]) + np.repeat(self.at[slots] - (ends - size), size)]

    def _library(self, keys: np.ndarray, ends_of: np.ndarray, units: list[bytes]) -> None:
        """Learn distinct units.  Those that begin with white space go in one string; a text's first word goes alone."""
        lone = [not (u[0] == 32 or u[0] == 10) for u in units]
        joined, alone = [i for i, x in enumerate(lone) if not x], [i for i, x in enumerate(lone) if x]
        for a in range(0, len(joined), 4096):
            part = joined[a : a + 4096]
            ids = np.array(self.tok.encode_batch_fast([b"".join(units[i] for i in part).decode()], add_special_tokens=False)[0].ids, np.int32)
            done = np.cumsum(self.bytes[ids])
            want = np.cumsum([len(units[i]) for i in part])
            ends = np.searchsorted(done, want)
            if not np.array_equal(done[ends], want):
                raise ValueError("a token crosses a word's end: this vocabulary is not byte-level BPE over words")
            self._add(keys[part], ends_of[part], np.diff(ends + 1, prepend=0), ids)
        if alone:
            ids = [e.ids for e in self.tok.encode_batch_fast([units[i].decode() for i in alone], add_special_tokens=False)]
            self._add(keys[alone], ends_of[alone], np.array([len(x) for x in ids]), np.array([y for x in ids for y in x], np.int32))

    def _learn(self, data: np.ndarray, run: np.ndarray, down: np.ndarray, keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """A letter and a comma or full stop after it are never in one token: word and mark are looked up apart."""
        keys, first = np.unique(keys, return_index=True)
        start, end = start[first], end[first]
        marked = _MARK[data[end - 1]] & (end - start > 2)
        marked[marked] = _LETTER[data[end[marked] - 2]]
        stems = _hash(run, down, start[marked], end[marked] - 1)
        new = np.concatenate([keys[~marked], stems])
        a, b = np.concatenate([start[~marked], start[marked]]), np.concatenate([end[~marked], end[marked] - 1])
        new, first = np.unique(new, return_index=True)
        fresh = self.slot.find(new) < 0
        raw = data.tobytes()
        if fresh.any():
            self._library(new[fresh], _ends(data, a[first][fresh], b[first][fresh]), [raw[x:y] for x, y in zip(a[first][fresh].tolist(), b[first][fresh].tolist())])
        left = (self.slot.find(keys) < 0) & marked
        if left.any():
            stem, own = self._gather(self.slot.find(stems[left[marked]]))
            last = data[end[left] - 1]
            if any(len(x) != 1 for x in self.marks.values()):
                raise ValueError("comma and full stop are one token each in this vocabulary")
            ends = np.cumsum(stem + 1)
            flat = np.empty(ends[-1], np.int32)
            at_mark = np.zeros(len(flat), bool)
            at_mark[ends - 1] = True
            flat[at_mark], flat[~at_mark] = np.where(last == 44, self.marks[44][0], self.marks[46][0]), own
            self._add(keys[left], _ends(data, start[left], end[left]), stem + 1, flat)

    def encode(self, data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Ids of each text, as int32 arrays without an end id; ``data`` and ``at`` are as of :func:`common.utf8`."""
        n = len(at) - 1
        out: list = [np.zeros(0, np.int32)] * n
        if not len(data):
            return out
        odd = irregular(data, at) | (at[1:] == at[:-1])
        for i in np.flatnonzero(odd).tolist():
            if at[i] < at[i + 1]:
                out[i] = np.array(self.tok.encode(data[at[i] : at[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.int32)
        if odd.all():
            return out
        if self.slot.n > self.keep:
            self.forget()
        cut = _GAP[data]
        cut[at[:-1][at[:-1] < len(data)]] = True
        if odd.any():
            cut &= ~np.repeat(odd, np.diff(at))
        start = np.flatnonzero(cut)
        texts = np.flatnonzero(~odd)
        first = np.searchsorted(start, at[texts])
        end = np.append(start[1:], len(data))
        end[np.append(first[1:], len(start)) - 1] = at[texts + 1]
        up, down = W._powers(len(data) + 1)
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CASED[data] * up[: len(data)], out=run[1:])
        keys = _hash(run, down, start, end)
        slots = self.slot.find(keys)
        lost = np.flatnonzero(slots < 0)
        if len(lost):
            self._learn(data, run, down, keys[lost], start[lost], end[lost])
            slots[lost] = self.slot.find(keys[lost])
        other = np.flatnonzero((self.ends[slots] != _ends(data, start, end)).any(axis=1))
        size, ids = self._gather(slots)
        stop = np.cumsum(size)[np.append(first[1:], len(start)) - 1]
        for i, a, b in zip(texts.tolist(), [0, *stop[:-1].tolist()], stop.tolist()):
            out[i] = ids[a:b]
        for i in np.unique(np.searchsorted(at, start[other], side="right") - 1).tolist():  # a word with the hash of another
            out[i] = np.array(self.tok.encode(data[at[i] : at[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.int32)
        return out


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
