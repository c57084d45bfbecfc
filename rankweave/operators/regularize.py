"""Regularization steps on whole factors, one an epoch; each takes and returns (w, h)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, each
from . import aggregate as A
from . import scale as S

Pair = tuple[DataFrame, DataFrame]


@dataclass(frozen=True)
class Regularizer:
    """``apply(v, w, h, rank, eps)``; ``per_stratum``: inside a stratum of d the step is eps / d."""

    name: str
    apply: Callable[[DataFrame, DataFrame, DataFrame, int, float], Pair]
    per_stratum: bool = True


def none() -> Regularizer:
    return Regularizer("None", lambda v, w, h, r, eps: (w, h))


def l1(lam_w: float, lam_h: float | None = None) -> Regularizer:
    """Towards 0 by eps * lambda; 0 itself counts as positive."""

    def apply(v, w, h, r, eps):
        def pull(df, c, lam):
            return df.withColumn(c, each(r, lambda k: F.when(F.col(c)[k] >= 0, F.col(c)[k] - eps * lam).otherwise(F.col(c)[k] + eps * lam)))

        return pull(w, "w", lam_w), pull(h, "h", lam_w if lam_h is None else lam_h)

    return Regularizer("L1", apply)


def l2(lam: float) -> Regularizer:
    """Times 1 - 2 eps lambda, kept positive for steps that are too large."""

    def apply(v, w, h, r, eps):
        f = 1 - 2 * eps * lam
        f = 0.25 / (1 - f) if f < 0.5 else f
        return S.times(w, "w", r, f), S.times(h, "h", r, f)

    return Regularizer("L2", apply)


def nzl2(lam: float) -> Regularizer:
    """Times 1 - 2 eps lambda nnz; eps is lowered when the largest count would make that too small."""

    def apply(v, w, h, r, eps):
        top = A.nnz_max(v).withColumn("eps", F.when(1 - 2 * eps * lam * F.col("nnz_max") < 0.5, (1 / (2 * lam * F.col("nnz_max"))) * (1 - 0.25 / (2 * eps * lam * F.col("nnz_max")))).otherwise(F.lit(eps)))

        def shrink(df, index, c):
            both = A.nnz_of(v, index, df).join(df, index).join(F.broadcast(top.select("eps")))  # one row
            return both.select(index, each(r, lambda k: F.col(c)[k] * (1 - 2 * F.col("eps") * lam * F.col("nnz"))).alias(c))

        return shrink(w, "i", "w"), shrink(h, "j", "h")

    return Regularizer("Nzl2", apply)


def _matrix(gram: DataFrame, rank: int) -> DataFrame:
    """One row: the Gram matrix as columns g0_0 .."""
    return gram.agg(*(F.max(F.when((F.col("a") == a) & (F.col("b") == b), F.col("value"))).alias(f"g{a}_{b}") for a in range(rank) for b in range(rank)))


def full_squared() -> Regularizer:
    """W -= 2 eps W(HH'), H -= 2 eps (W'W)H, both Gram matrices of the factors before."""

    def apply(v, w, h, r, eps):
        def less(df, c, gram):
            both = df.join(F.broadcast(_matrix(gram, r)))  # one row
            row = lambda k: F.array(*(F.col(f"g{a}_{k}") for a in range(r)))
            return both.withColumn(c, each(r, lambda k: F.col(c)[k] - 2 * eps * dot(F.col(c), row(k), r))).select(df.columns)

        return less(w, "w", A.gram(h, "h", r)), less(h, "h", A.gram(w, "w", r))

    return Regularizer("Sl", apply, per_stratum=False)


def gkl() -> Regularizer:
    """w -= eps * component sums of H, h -= eps * component sums of W, both of the factors before."""

    def apply(v, w, h, r, eps):
        def less(df, c, other, oc):
            sums = other.agg(F.array(*(F.sum(F.col(oc)[k]) for k in range(r))).alias("sums"))
            return df.join(F.broadcast(sums)).withColumn(c, each(r, lambda k: F.col(c)[k] - eps * F.col("sums")[k])).select(df.columns)  # one row

        return less(w, "w", h, "h"), less(h, "h", w, "w")

    return Regularizer("Gkl", apply, per_stratum=False)


def with_abs(inner: Regularizer) -> Regularizer:
    def apply(v, w, h, r, eps):
        w, h = inner.apply(v, w, h, r, eps)
        return S.absolute(w, "w", r), S.absolute(h, "h", r)

    return Regularizer(f"Abs({inner.name})", apply, inner.per_stratum)


def with_truncate(inner: Regularizer, low: float, high: float) -> Regularizer:
    """Truncation after the step; around no regularizer it does nothing."""
    if inner.name == "None":
        return inner

    def apply(v, w, h, r, eps):
        w, h = inner.apply(v, w, h, r, eps)
        return S.truncated(w, "w", r, low, high), S.truncated(h, "h", r, low, high)

    return Regularizer(f"Truncate({inner.name})", apply, inner.per_stratum)


def with_max_norm(inner: Regularizer, b_sq: float) -> Regularizer:
    """Vectors whose squared norm exceeds ``b_sq`` are divided by ``b_sq``, once."""

    def apply(v, w, h, r, eps):
        w, h = inner.apply(v, w, h, r, eps)
        cut = lambda df, c: df.withColumn(c, each(r, lambda k: F.when(dot(c, c, r) > b_sq, F.col(c)[k] / b_sq).otherwise(F.col(c)[k])))
        return cut(w, "w"), cut(h, "h")

    return Regularizer(f"MaxNorm({inner.name})", apply, inner.per_stratum)
