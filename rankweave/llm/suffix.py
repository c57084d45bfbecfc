"""Suffix arrays by induced sorting, and permuted common prefixes, over NumPy arrays.

Induced sorting (Nong, Zhang and Chan, 2009): a suffix is smaller (S) or larger (L) than the one
after it; the leftmost smaller ones (LMS) are sorted by their substrings, then by recursion on
the string of those substrings' names, and all others are induced from them in one pass up (L)
and one pass down (S).  A pass takes all suffixes that are in place up to the first gap at once:
they put their left neighbours in place, in order, and so close the gap.  A run of equal symbols
is laid out in one step.  Work is linear; strings of names close gaps in about sqrt(n) steps.

Permuted common prefixes (Karkkainen, Manzini and Puglisi, 2009): for each place of the text the
symbols it shares with the suffix sorted just before.  Only where the symbols to the left differ
are they counted; elsewhere they are one less than those of the place to the left.
"""

from __future__ import annotations

import numpy as np


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)[:-1]])


def _pass(text: np.ndarray, run_start: np.ndarray, slots: np.ndarray, direct: np.ndarray, seeds: np.ndarray, n_seeds: np.ndarray) -> np.ndarray:
    """All suffixes of one kind in the order of a pass, bucket by bucket of ``text``.

    A bucket has ``slots`` suffixes of this kind, ``direct`` of them before a smaller symbol, and
    then its part of the ``seeds``, which are of the other kind.  A suffix before an equal symbol
    follows the one after it, so all of a bucket's are laid out once its direct ones are.
    """
    begin = _starts(slots + n_seeds)
    order = np.full(int(slots.sum()) + len(seeds), -1, np.int64)
    at = np.repeat(begin + slots - _starts(n_seeds), n_seeds) + np.arange(len(seeds))
    order[at] = seeds
    own = np.ones(len(order), bool)
    own[at] = False
    head, a, n = begin.copy(), 0, len(order)
    while a < n:
        b, step = a, 1024
        while b < n:  # the first gap
            gap = order[b : b + step] < 0
            k = int(gap.argmax())
            if gap[k]:
                b += k
                break
            b, step = b + len(gap), step * 2
        if b == a:  # what precedes equal symbols in this bucket
            c = int(np.searchsorted(begin, a, side="right")) - 1
            ends = order[begin[c] : begin[c] + direct[c]]
            more = ends - run_start[ends]
            far = np.repeat(np.arange(len(ends)), more)
            back = np.arange(len(far)) - np.repeat(_starts(more), more) + 1
            by = np.argsort(back, kind="stable")
            order[a : a + len(far)] = (ends[far] - back)[by]
            if not len(far):
                raise AssertionError("a gap without a source")
            continue
        left = order[a:b] - 1
        left = left[left >= 0] if a == 0 or len(left) and left.min() < 0 else left
        symbol = text[left]
        keep = symbol > text[left + 1]
        left, symbol = left[keep], symbol[keep]
        if len(left):
            by = np.argsort(symbol, kind="stable")
            left, symbol = left[by], symbol[by]
            first = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
            count = np.diff(np.append(first, len(symbol)))
            which = symbol[first]
            order[np.repeat(head[which] - first, count) + np.arange(len(left))] = left
            head[which] += count
        a = b
    return order[own]


def _induced(text: np.ndarray, flipped: np.ndarray, small: np.ndarray, run_start: np.ndarray, sizes, lms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All L suffixes ascending and all S suffixes but the last one descending, from LMS suffixes in the order ``lms``."""
    n_large, direct_large, n_small, direct_small, n_lms = sizes
    large = _pass(text, run_start, n_large, direct_large, lms, n_lms)
    return large, _pass(flipped, run_start, n_small[::-1], direct_small[::-1], large[::-1], n_large[::-1])


def _named(text: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings in text order, equal for equal ones, from the sorted order of the LMS places."""
    end = np.empty(len(text), np.int64)
    end[lms] = np.append(lms[1:], lms[-1])
    size = end[order] - order
    new = np.ones(len(order), bool)
    live = np.flatnonzero(size[1:] == size[:-1]) + 1
    new[live] = False
    k = 0
    while len(live):
        x, y = order[live] + k, order[live - 1] + k
        differ = text[x] != text[y]
        new[live[differ]] = True
        live = live[~differ & (k < size[live])]
        k += 1
    name = np.empty(len(text), np.int64)
    name[order] = np.cumsum(new) - 1
    return name[lms], int(new.sum())


def _sorted(text: np.ndarray, symbols: int) -> np.ndarray:
    """Suffix array of a text that ends with its only 0; symbols are below ``symbols``."""
    n = len(text)
    if n < 3:
        return np.arange(n)[::-1].copy()
    wide = text.astype(np.int64)
    step = np.sign(np.diff(wide))
    places = np.arange(n - 1)
    last = np.minimum.accumulate(np.where(step != 0, places, n)[::-1])[::-1]  # where the run of equal symbols ends
    small = np.append(step[np.minimum(last, n - 2)] > 0, True)
    run_start = np.maximum.accumulate(np.where(np.concatenate([[True], step != 0]), np.arange(n), 0))
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    count = lambda where: np.bincount(wide[where], minlength=symbols)
    alone = np.append(step != 0, False)
    n_small = count(small)
    n_small[0] -= 1  # the last place has nothing after it
    sizes = count(~small), count(~small & alone), n_small, count(small & alone), count(lms)
    flipped = (symbols - 1 - wide).astype(text.dtype)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    if len(lms) > 1:
        _, down = _induced(text, flipped, small, run_start, sizes, lms[np.argsort(text[lms], kind="stable")])
        order = np.append(n - 1, down[::-1][is_lms[down[::-1]]])
        names, distinct = _named(text, lms, order)
        if distinct < len(lms):
            order = lms[_sorted(names.astype(np.uint16 if distinct < 1 << 16 else np.int64), distinct)]
        lms = order
    large, down = _induced(text, flipped, small, run_start, sizes, lms)
    n_large, up = sizes[0], np.append(n - 1, down[::-1])
    out = np.empty(n, np.int64)
    n_small[0] += 1
    at = np.repeat(_starts(n_large + n_small) - _starts(n_large), n_large) + np.arange(len(large))
    free = np.ones(n, bool)
    free[at] = False
    out[at] = large
    out[free] = up
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of the suffixes of an array of numbers from 0 on, in ascending order; one that is another's beginning comes first."""
    if not len(text):
        return np.zeros(0, np.int64)
    top = int(text.max()) + 2
    return _sorted(np.append(text.astype(np.int64) + 1, 0).astype(np.uint16 if top < 1 << 16 else np.int64), top)[1:]


def _eights(data: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as one number; zeros follow the end."""
    held = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, np.dtype("<u8"), held, strides=(1,))


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place of a byte string, how many bytes its suffix shares with the one before it in ``order``; 0 for the first."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    fresh = before >= 0
    fresh[1:] &= (before[1:] <= 0) | (data[:-1] != data[np.maximum(before[1:], 1) - 1]) | (before[:-1] < 0)
    live = at[fresh]
    shared = np.zeros(n, np.int64)
    eight = _eights(data)
    while len(live):
        x, y = live + shared[live], before[live] + shared[live]
        left = n - np.maximum(x, y)
        differ = eight[np.minimum(x, n)] ^ eight[np.minimum(y, n)]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.minimum(np.frexp(low.astype(np.float64))[1] - 1, 63) // 8)
        shared[live] += np.minimum(same, left)
        live = live[(same == 8) & (left > 8)]
    known = fresh | (before < 0)
    last = np.maximum.accumulate(np.where(known, at, 0))  # from there on it falls by one a place
    return np.maximum(shared[last] - (at - last), 0)
