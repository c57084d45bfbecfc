"""One stochastic-gradient step per entry, as expressions over entries joined with both vectors.

Every step reads the old vectors.  A step is a pair of functions (k -> new w_k, k -> new h_k)
over the columns x, w, h and, where the penalty is per entry, nnz1 and nnz2.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, each, ratio, soft_truncate
from . import aggregate as A
from .loss import entries

Step = tuple[Callable[[int], Column], Callable[[int], Column]]


@dataclass(frozen=True)
class Update:
    """A named rule; ``step(rank, eps)`` gives the two component functions."""

    name: str
    step: Callable[[int, float], Step]
    counts: bool = False


def _w(k):
    return F.col("w")[k]


def _h(k):
    return F.col("h")[k]


def _error(rank: int) -> Column:
    return F.col("x") - dot("w", "h", rank)


def none() -> Update:
    return Update("None", lambda r, eps: (_w, _h))


def squared() -> Update:
    def step(r, eps):
        g = 2 * eps * _error(r)
        return lambda k: _w(k) + g * _h(k), lambda k: _h(k) + g * _w(k)

    return Update("Nzsl", step)


def squared_l2(lam: float) -> Update:
    """The penalty of a row is shared by its entries."""

    def step(r, eps):
        g = 2 * eps * _error(r)
        a, b = 2 * eps * lam / F.col("nnz1"), 2 * eps * lam / F.col("nnz2")
        return lambda k: _w(k) + g * _h(k) - a * _w(k), lambda k: _h(k) + g * _w(k) - b * _h(k)

    return Update("Nzsl_L2", step, counts=True)


def squared_nzl2(lam: float) -> Update:
    def step(r, eps):
        g, a = 2 * eps * _error(r), 2 * eps * lam
        return lambda k: _w(k) + g * _h(k) - a * _w(k), lambda k: _h(k) + g * _w(k) - a * _h(k)

    return Update("Nzsl_Nzl2", step)


def squared_l1(lam: float) -> Update:
    """Sub-gradient of the L1 penalty shared by entries; at exactly 0 the step is soft-thresholded."""

    def moved(old, gradient, pull):
        soft = F.when(gradient > pull, gradient - pull).when(gradient < -pull, gradient + pull).otherwise(0.0)
        return F.when(old > 0, old + gradient - pull).when(old < 0, old + gradient + pull).otherwise(soft)

    def step(r, eps):
        g = 2 * eps * _error(r)
        a, b = eps * lam / F.col("nnz1"), eps * lam / F.col("nnz2")
        return lambda k: moved(_w(k), g * _h(k), a), lambda k: moved(_h(k), g * _w(k), b)

    return Update("Nzsl_L1", step, counts=True)


def biased(lam_w: float, lam_h: float, lam_row: float, lam_col: float) -> Update:
    """Component 0 of either vector is an additive bias with a penalty of its own."""

    def step(r, eps):
        g = 2 * eps * (F.col("x") - _w(0) - _h(0) - dot("w", "h", r, 1))
        w = lambda k: _w(0) + g - 2 * eps * lam_row * _w(0) if k == 0 else _w(k) + g * _h(k) - 2 * eps * lam_w * _w(k)
        h = lambda k: _h(0) + g - 2 * eps * lam_col * _h(0) if k == 0 else _h(k) + g * _w(k) - 2 * eps * lam_h * _h(k)
        return w, h

    return Update("Biased", step)


def full_squared() -> Update:
    def step(r, eps):
        g = 2 * eps * F.col("x")
        return lambda k: _w(k) + g * _h(k), lambda k: _h(k) + g * _w(k)

    return Update("Sl", step)


def gkl() -> Update:
    """A product of 0 leaves the vectors as they are."""

    def step(r, eps):
        g = F.coalesce(eps * ratio(F.col("x"), dot("w", "h", r)), F.lit(0.0))
        return lambda k: _w(k) + g * _h(k), lambda k: _h(k) + g * _w(k)

    return Update("Gkl", step)


def with_abs(inner: Update) -> Update:
    def step(r, eps):
        w, h = inner.step(r, eps)
        return lambda k: F.abs(w(k)), lambda k: F.abs(h(k))

    return Update(f"Abs({inner.name})", step, inner.counts)


def with_truncate(inner: Update, low: float, high: float, low_h: float | None = None, high_h: float | None = None) -> Update:
    def step(r, eps):
        w, h = inner.step(r, eps)
        return lambda k: soft_truncate(w(k), low, high), lambda k: soft_truncate(h(k), low if low_h is None else low_h, high if high_h is None else high_h)

    return Update(f"Truncate({inner.name})", step, inner.counts)


def with_max_norm(inner: Update, b_sq: float) -> Update:
    """Vectors whose squared norm exceeds ``b_sq`` are divided by ``b_sq``."""

    def step(r, eps):
        def bounded(f):
            n = sum((f(k) * f(k) for k in range(1, r)), f(0) * f(0))
            return lambda k: F.when(n > b_sq, f(k) / b_sq).otherwise(f(k))

        w, h = inner.step(r, eps)
        return bounded(w), bounded(h)

    return Update(f"MaxNorm({inner.name})", step, inner.counts)


def step_entries(update: Update, v: DataFrame, w: DataFrame, h: DataFrame, rank: int, eps: float) -> DataFrame:
    """(i, j, w, h): what one step on each entry alone makes of its row's and column's vectors."""
    e = entries(v, w, h)
    if update.counts:
        e = e.join(A.nnz_of(v, "i").withColumnRenamed("nnz", "nnz1"), "i").join(A.nnz_of(v, "j").withColumnRenamed("nnz", "nnz2"), "j")
    fw, fh = update.step(rank, eps)
    return e.select("i", "j", each(rank, fw).alias("w"), each(rank, fh).alias("h"))
