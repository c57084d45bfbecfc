"""Stochastic gradient descent inside one block, on NumPy arrays.

Steps on entries that share no row and no column commute.  In any sequence of entries, one is ready
when the entries before it in its row and in its column are done; those that are ready together are one
vectorised step, and step by step they give what the sequence gives.  Finding them is one sort by
row, one by column, and work on the ready entries alone.

A row (or column) with very many entries would need a step for each of them.  Where updates are linear
in the factors, ``BURST`` of its entries that follow each other are solved at once: the errors of a row's
successive steps are the solution of a triangular system in the Gram matrix of the columns' vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Entries of a heavy row or column that are solved at once, and how many make one heavy.
BURST, HEAVY = 64, 1024
#: Updates whose steps on one row are a linear recurrence.
LINEAR = ("Nzsl", "Nzsl_L2", "Nzsl_Nzl2")


def _bursts(i: np.ndarray, j: np.ndarray, sequence: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sequence with the entries of heavy rows, then columns, drawn together in bursts (those with over ``most``); where each unit (a burst or one entry) starts; and whether it is of a row, a column or neither (0, 1, -1)."""
    n = len(sequence)
    lead, side = np.arange(n), np.full(n, -1, np.int8)
    for k, axis in enumerate((i[sequence], j[sequence])):
        heavy = (np.bincount(axis)[axis] > most) & (side < 0)
        if not heavy.any():
            continue
        own = np.flatnonzero(heavy)
        by = own[np.argsort(axis[own], kind="stable")]
        new = np.flatnonzero(np.concatenate([[True], axis[by][1:] != axis[by][:-1]]))
        place = np.arange(len(by)) - np.repeat(new, np.diff(np.append(new, len(by))))
        lead[by] = by[np.arange(len(by)) - place % BURST]
        side[by] = k
    order = np.argsort(lead, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], lead[order][1:] != lead[order][:-1]]))
    return sequence[order], start, side[order][start]


def _after(axis: np.ndarray, unit: np.ndarray, waits: np.ndarray) -> np.ndarray:
    """For each entry the unit of the next entry in its row (or column), -1 if that is none or its own; counts what each unit waits for."""
    by = np.argsort(axis, kind="stable")
    link = (axis[by][1:] == axis[by][:-1]) & (unit[by][1:] != unit[by][:-1])
    out = np.full(len(axis), -1, np.int64)
    out[by[:-1][link]] = unit[by[1:][link]]
    waits += np.bincount(unit[by[1:][link]], minlength=len(waits))
    return out


def waves(i: np.ndarray, j: np.ndarray, sequence: np.ndarray, bursts: bool = False, most: int | None = None) -> Iterator[tuple[np.ndarray, list[tuple[int, np.ndarray]]]]:
    """Entries that are ready together: single ones, and bursts (0 of a row or 1 of a column, and a row of entries for each) of one size a piece.

    One wave after another is the sequence; with ``bursts`` that in which the entries of heavy rows
    and columns are drawn together.
    """
    if not len(sequence):
        return
    start, side = np.arange(len(sequence)), np.full(len(sequence), -1, np.int8)
    if bursts:
        sequence, start, side = _bursts(i, j, sequence, HEAVY if most is None else most)
    size = np.diff(np.append(start, len(sequence)))
    unit, waits = np.repeat(np.arange(len(start)), size), np.zeros(len(start), np.int64)
    after = np.stack([_after(i[sequence], unit, waits), _after(j[sequence], unit, waits)], axis=1)
    alone = not (size > 1).any()
    ready = np.flatnonzero(waits == 0)
    while len(ready):
        many = ready[:0] if alone else ready[size[ready] > 1]
        own = start[ready] if not len(many) else start[ready[size[ready] == 1]]
        groups = []
        for k, m in {*zip(side[many].tolist(), size[many].tolist())} if len(many) else ():
            groups.append((k, start[many[(side[many] == k) & (size[many] == m)]][:, None] + np.arange(m)))
        yield sequence[own], [(k, sequence[g]) for k, g in groups]
        follow = after[np.concatenate([own, *(g.ravel() for _, g in groups)]) if groups else own].ravel()
        follow = follow[follow >= 0]
        np.subtract.at(waits, follow, 1)
        follow = follow[waits[follow] == 0]
        waits[follow] = -1
        ready = np.unique(follow) if len(follow) else follow


def burst(x: np.ndarray, one: np.ndarray, many: np.ndarray, eps: float, keep_one: np.ndarray, keep_many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Successive steps of squared loss on entries ``x`` (b, m) of b rows with vectors ``one`` (b, r) and of columns with ``many`` (b, m, r), which are distinct.

    A step keeps ``keep_one`` (b) of the row's vector and ``keep_many`` (b, m) of the column's.
    """
    m = x.shape[1]
    step = np.arange(m)
    power = keep_one[:, None] ** step  # what t steps keep
    decay = np.tril(keep_one[:, None, None] ** np.maximum(step[:, None] - step[None, :] - 1, 0), -1)
    system = np.eye(m) + 2 * eps * decay * (many @ many.transpose(0, 2, 1))
    error = np.linalg.solve(system, (x - power * (many @ one[:, :, None])[:, :, 0])[:, :, None])
    pull = 2 * eps * error * many
    before = power[:, :, None] * one[:, None, :] + decay @ pull
    return keep_one[:, None] * before[:, -1] + pull[:, -1], keep_many[:, :, None] * many + 2 * eps * error * before


def cache_blocks(size1: int, size2: int, nnz: int, rank: int, cache_kb: float) -> int:
    """Blocks a side so that the entries (three numbers each) and factor rows of a block fill the cache: the root of ``cache * b**2 = (size1 + size2) * rank * 8 * b + nnz * 24``."""
    cache, factors = cache_kb * 1024, (size1 + size2) * rank * 8
    return max(1, int((factors + (factors**2 + 4 * cache * nnz * 24) ** 0.5) / (2 * cache)))


def step(kind: str, args: tuple, x, w, h, eps, n1=None, n2=None):
    """New rows w and h of entries x; ``n1`` and ``n2`` are the counts of their rows and columns."""
    if kind in ("Sl", "None"):
        g = 2 * eps * x[:, None] if kind == "Sl" else np.zeros((len(x), 1))
        return w + g * h, h + g * w
    if kind == "Biased":
        lw, lh, lr, lc = args
        g = 2 * eps * (x - w[:, 0] - h[:, 0] - (w[:, 1:] * h[:, 1:]).sum(axis=1))[:, None]
        nw, nh = w + g * h - 2 * eps * lw * w, h + g * w - 2 * eps * lh * h
        nw[:, :1], nh[:, :1] = w[:, :1] + g - 2 * eps * lr * w[:, :1], h[:, :1] + g - 2 * eps * lc * h[:, :1]
        return nw, nh
    dot = (w * h).sum(axis=1)
    if kind == "Gkl":
        g = (eps * np.divide(x, dot, out=np.zeros_like(dot), where=dot != 0))[:, None]
        return w + g * h, h + g * w
    g = (2 * eps * (x - dot))[:, None]
    if kind == "Nzsl":
        return w + g * h, h + g * w
    if kind == "Nzsl_Nzl2":
        return w + g * h - 2 * eps * args[0] * w, h + g * w - 2 * eps * args[0] * h
    if kind == "Nzsl_L2":
        return w + g * h - 2 * eps * args[0] * w / n1[:, None], h + g * w - 2 * eps * args[0] * h / n2[:, None]
    if kind == "Nzsl_L1":
        def moved(old, grad, pull):
            soft = np.sign(grad) * np.maximum(np.abs(grad) - pull, 0)
            return np.where(old > 0, old + grad - pull, np.where(old < 0, old + grad + pull, soft))

        return moved(w, g * h, (eps * args[0] / n1)[:, None]), moved(h, g * w, (eps * args[0] / n2)[:, None])
    raise ValueError(f"unknown update {kind!r}")


def finish(v: np.ndarray, abs_: bool, truncate: tuple | None, max_norm: float | None) -> np.ndarray:
    if abs_:
        v = np.abs(v)
    if truncate:
        low, high = truncate
        v = np.where(v <= low, low + 1e-8, np.where(v >= high, high - 1e-8, v))
    if max_norm is not None:
        v = np.where((v * v).sum(axis=1, keepdims=True) > max_norm, v / max_norm, v)
    return v


def sequence_of(order: str, i: np.ndarray, j: np.ndarray, size1: int, size2: int, rng: np.random.Generator, cells: int = 1) -> np.ndarray:
    """Numbers of the entries in the order of a pass: SEQ (as stored), WOR (random permutation) or WR (draws with replacement).

    With ``cells`` > 1, WOR visits the squares of a cells x cells grid in random order, and the
    entries of a square in random order.
    """
    n = len(i)
    if order == "SEQ":
        return np.arange(n)
    if order == "WR":
        return rng.integers(0, n, n)
    if order == "WOR":
        sequence = rng.permutation(n)
        if cells > 1:
            square = i * cells // size1 * cells + j * cells // size2
            if cells * cells > max(4 * n, 1 << 20):  # most squares are empty
                square = np.unique(square, return_inverse=True)[1]
                square = rng.permutation(int(square.max(initial=0)) + 1)[square]
            else:
                square = rng.permutation(cells * cells)[square]
            sequence = sequence[np.argsort(square[sequence], kind="stable")]
        return sequence
    raise ValueError(f"unknown order {order!r}: SEQ, WOR or WR")


def epoch(kind, args, i, j, x, w, h, eps, rng, n1=None, n2=None, order="WOR", abs_=False, truncate=None, max_norm=None, cells: int = 1) -> None:
    """One pass over the entries, changing w and h in place.

    ``order`` and ``cells`` are as in :func:`sequence_of`; WOR draws the entries of heavy rows and columns together.
    """
    if not len(x):
        return
    sequence = sequence_of(order, i, j, len(w), len(h), rng, cells)
    linear = kind in LINEAR and order != "WR" and not abs_ and truncate is None and max_norm is None
    if linear and order == "SEQ":  # only where its rows or columns lie together
        linear = bool((_bursts(i, j, sequence, HEAVY)[0] == sequence).all())
    lam = args[0] if args else 0.0
    keep = lambda n, of: 1 - 2 * eps * lam / (n[of] if kind == "Nzsl_L2" else 1) + np.zeros(of.shape)
    for p, groups in waves(i, j, sequence, linear):
        a, b = i[p], j[p]
        if len(p):
            nw, nh = step(kind, args, x[p], w[a], h[b], eps, None if n1 is None else n1[a], None if n2 is None else n2[b])
            w[a], h[b] = finish(nw, abs_, truncate, max_norm), finish(nh, abs_, truncate, max_norm)
        for side, q in groups:
            one, many, n_one, n_many, at, to = (w, h, n1, n2, i[q[:, 0]], j[q]) if side == 0 else (h, w, n2, n1, j[q[:, 0]], i[q])
            one[at], many[to] = burst(x[q], one[at], many[to], eps, keep(n_one, at), keep(n_many, to))
