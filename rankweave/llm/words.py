"""Words and their 64-bit hashes over whole batches of text, without a Python loop over words.

A word is a run of bytes other than space and ``\\t\\n\\v\\f\\r``, with A-Z lower-cased; that is
the pattern ``[^\\x20\\x09-\\x0D]+`` of the contracts, as no UTF-8 sequence holds those bytes.
The hash of bytes b0..bn is the polynomial sum of T[bi] * P**i modulo 2**64 for a table T of
random numbers, found for all words at once from one running sum, then mixed.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
_TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE[65:91] = _TABLE[97:123]  # A-Z hash as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, (1 << 20) + 64)
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, p, np.uint64)])) for p in (_BASE, _INVERSE)]
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on all input bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans(data: np.ndarray, at: np.ndarray, white: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the n + 1 offsets of the texts' words; ``white`` marks the bytes that no word holds."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    edge = np.ones(len(data) + 1, bool)  # here a word must end: a white byte or a text's end
    edge[:-1] = white[data]
    word = ~edge[:-1]
    edge[at] = True
    before = np.empty(len(data), bool)  # white byte before, or a text's start
    before[0] = True
    before[1:] = ~word[:-1]
    before[at[:-1][at[:-1] < len(data)]] = True
    start = np.flatnonzero(word & before)
    end = np.flatnonzero(word & (edge[1:])) + 1
    return start, end, np.searchsorted(start, at)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, letters A-Z as a-z."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=run[1:])
    return mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(words: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; a shorter text is one shingle, an empty one none."""
    n = len(words)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        if n - k + 1 > 0:
            out[: n - k + 1] += words[j : n - k + 1 + j] * np.uint64(2 * pow(0xD6E8FEB86659FD93, j + 1, 1 << 63) + 1 & (1 << 64) - 1)
    out = mix(out)
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            sets.append(np.unique(out[a : b - k + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for w in words[a:b]:
                whole = mix(np.array([whole]) * np.uint64(0xD6E8FEB86659FD93) + w)[0]
            sets.append(np.array([whole], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
