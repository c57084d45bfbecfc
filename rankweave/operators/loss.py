"""Loss functions; each gives one row with the column ``loss``.

Losses of stored cells join entries with both factors on the indexes; model terms over all cells
use the algebraic forms of :mod:`aggregate`, so no plan is larger than entries plus factors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, ratio
from . import aggregate as A

INFINITY = float("inf")


def entries(v: DataFrame, w: DataFrame, h: DataFrame) -> DataFrame:
    """Entries with the row's and the column's vector."""
    return v.join(w, "i").join(h, "j")


def squared(v, w, h, rank: int) -> DataFrame:
    """Sum over stored cells of (x - wh)**2."""
    e = F.col("x") - dot("w", "h", rank)
    return entries(v, w, h).agg(F.sum(e * e).alias("loss"))


def rmse(v, w, h, rank: int) -> DataFrame:
    e = F.col("x") - dot("w", "h", rank)
    return entries(v, w, h).agg(F.sqrt(F.sum(e * e) / F.count("*")).alias("loss"))


def full_squared_data(v, w, h, rank: int) -> DataFrame:
    x = F.col("x")
    return entries(v, w, h).agg(F.sum(x * x - 2 * x * dot("w", "h", rank)).alias("loss"))


def full_squared_model(w, h, rank: int) -> DataFrame:
    return A.product_square_sum(w, h, rank).withColumnRenamed("total", "loss")


def full_squared(v, w, h, rank: int) -> DataFrame:
    """Sum over all cells, absent ones being 0."""
    return summed(full_squared_data(v, w, h, rank), full_squared_model(w, h, rank))


def kl_data(v, w, h, rank: int, minus_x: bool = True) -> DataFrame:
    """Sum over stored non-zero cells of x ln(x / |wh|) [- x]; infinite if some wh is 0."""
    x, d = F.col("x"), F.abs(dot("w", "h", rank))
    term = F.when(d == 0, INFINITY).otherwise(x * F.log(ratio(x, d)) - (x if minus_x else 0.0))
    return entries(v, w, h).filter("x <> 0").agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("loss"))


def kl(v, w, h, rank: int) -> DataFrame:
    return kl_data(v, w, h, rank, minus_x=False)


def gkl_model(w, h, rank: int) -> DataFrame:
    return A.product_sum(w, h, rank).withColumnRenamed("total", "loss")


def gkl(v, w, h, rank: int) -> DataFrame:
    """Generalized Kullback-Leibler divergence, absent cells being 0, and 0 at least."""
    return summed(kl_data(v, w, h, rank), gkl_model(w, h, rank)).select(F.greatest(F.lit(0.0), "loss").alias("loss"))


def biased_squared(v, w, h, rank: int) -> DataFrame:
    """Component 0 of either vector is an additive bias."""
    e = F.col("x") - F.col("w")[0] - F.col("h")[0] - dot("w", "h", rank, 1)
    return entries(v, w, h).agg(F.sum(e * e).alias("loss"))


def _norm(df: DataFrame, vector: str, rank: int, f, first: int = 0, last: int | None = None) -> DataFrame:
    terms = [f(F.col(vector)[k]) for k in range(first, rank if last is None else last)]
    return df.agg(F.coalesce(F.sum(reduce(lambda a, b: a + b, terms)), F.lit(0.0)).alias("loss"))


def _times(df: DataFrame, factor: float) -> DataFrame:
    return df.select((F.lit(float(factor)) * F.col("loss")).alias("loss"))


def l1(w, h, rank: int, lam_w: float, lam_h: float | None = None) -> DataFrame:
    """lam_w |W| + lam_h |H|, entrywise; lambda counts whatever the plan."""
    return summed(_times(_norm(w, "w", rank, F.abs), lam_w), _times(_norm(h, "h", rank, F.abs), lam_w if lam_h is None else lam_h))


def l2(w, h, rank: int, lam: float) -> DataFrame:
    sq = lambda x: x * x
    return summed(_times(_norm(w, "w", rank, sq), lam), _times(_norm(h, "h", rank, sq), lam))


def _counted(df: DataFrame, index: str, counts: DataFrame) -> DataFrame:
    return df.join(counts, index)


def weighted_l2(v, w, h, rank: int, lam: float) -> DataFrame:
    """lam (sum nnz_i |w_i|**2 + sum nnz_j |h_j|**2)."""
    sq = lambda x: F.col("nnz") * x * x
    return summed(
        _times(_norm(_counted(w, "i", A.nnz_of(v, "i")), "w", rank, sq), lam),
        _times(_norm(_counted(h, "j", A.nnz_of(v, "j")), "h", rank, sq), lam),
    )


def biased_weighted_l2(v, w, h, rank: int, lam_w: float, lam_h: float | None = None, lam_row: float | None = None, lam_col: float | None = None) -> DataFrame:
    """Weighted L2 with weights of their own for factors and biases: (all), (factors, biases) or (W, H, row bias, column bias)."""
    if lam_h is None:
        lam = (lam_w,) * 4
    elif lam_row is None:
        lam = (lam_w, lam_w, lam_h, lam_h)
    else:
        lam = (lam_w, lam_h, lam_row, lam_col)
    sq = lambda x: F.col("nnz") * x * x
    cw, ch = _counted(w, "i", A.nnz_of(v, "i")), _counted(h, "j", A.nnz_of(v, "j"))
    parts = [(cw, "w", 1, None), (ch, "h", 1, None), (cw, "w", 0, 1), (ch, "h", 0, 1)]
    return summed(*(_times(_norm(df, c, rank, sq, a, b), x) for (df, c, a, b), x in zip(parts, lam) if x and (a == 0 or rank > 1)))


def nothing(spark) -> DataFrame:
    return spark.range(1).select(F.lit(0.0).alias("loss"))


def summed(*losses: DataFrame) -> DataFrame:
    """The sum of losses."""
    return reduce(DataFrame.unionAll, losses).agg(F.sum("loss").alias("loss"))
