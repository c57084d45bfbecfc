"""Multiplicative updates: non-negative factorization of squared loss (GNMF) and of generalized KL divergence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, each, ratio, safe_ratio
from ..operators import aggregate as A
from ..operators.loss import entries
from ..operators.regularize import _matrix


def _product(v: DataFrame, fixed: DataFrame, index: str, other: str, fc: str, rank: int) -> DataFrame:
    """(index, p): V times the fixed factor."""
    f = F.col(fc)
    return v.join(fixed.select(other, fc), other).groupBy(index).agg(F.array(*(F.sum(F.col("x") * f[k]) for k in range(rank))).alias("p"))


def gnmf_step(v: DataFrame, w: DataFrame, h: DataFrame, rank: int, side: str) -> DataFrame:
    """h * (W'V) / (W'W h), or w * (VH') / (w HH'); quotients that are not finite are 0, so empty rows become 0."""
    index, other, oc, fixed, fc, old = ("j", "i", "h", w, "w", h) if side == "h" else ("i", "j", "w", h, "h", w)
    both = old.join(_product(v, fixed, index, other, fc, rank), index, "left").join(F.broadcast(_matrix(A.gram(fixed, fc, rank), rank)))  # one row
    top = lambda k: F.coalesce(F.col("p")[k], F.lit(0.0))
    low = lambda k: dot(F.col(oc), F.array(*(F.col(f"g{k}_{b}") for b in range(rank))), rank)
    return both.select(index, each(rank, lambda k: F.col(oc)[k] * safe_ratio(top(k), low(k))).alias(oc))


def kl_step(v: DataFrame, w: DataFrame, h: DataFrame, rank: int, side: str) -> DataFrame:
    """w * (sum_j x / wh * h) / (component sums of H), and the same for h; entries with wh = 0 add nothing."""
    index, oc, fc, fixed, old = ("i", "w", "h", h, w) if side == "w" else ("j", "h", "w", w, h)
    q = F.coalesce(ratio(F.col("x"), dot("w", "h", rank)), F.lit(0.0))
    p = entries(v, w, h).groupBy(index).agg(F.array(*(F.sum(q * F.col(fc)[k]) for k in range(rank))).alias("p"))
    sums = fixed.agg(F.array(*(F.sum(F.col(fc)[k]) for k in range(rank))).alias("s"))
    both = old.join(p, index, "left").join(F.broadcast(sums))  # one row
    return both.select(index, each(rank, lambda k: F.col(oc)[k] * safe_ratio(F.coalesce(F.col("p")[k], F.lit(0.0)), F.col("s")[k])).alias(oc))
