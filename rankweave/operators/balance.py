"""Balancing: rescale factors so that the penalty is least and the product stays the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import each, ratio
from . import aggregate as A


def _penalties(v: DataFrame, w: DataFrame, h: DataFrame, rank: int, kind: str) -> DataFrame:
    """(k, pw, ph): penalty of each component of W and of H."""
    if kind.upper() == "L2":
        pw, ph = A.component_square_sums(w, "w", rank), A.component_square_sums(h, "h", rank)
    elif kind.upper() == "NZL2":
        pw = A.weighted_square_sums(w, A.nnz_of(v, "i"), "i", "w", rank)
        ph = A.weighted_square_sums(h, A.nnz_of(v, "j"), "j", "h", rank)
    else:
        raise ValueError(f"unknown balancing {kind!r}: None, L2 or Nzl2")
    return pw.withColumnRenamed("total", "pw").join(ph.withColumnRenamed("total", "ph"), "k")


def balanced(v: DataFrame, w: DataFrame, h: DataFrame, rank: int, kind: str = "L2", method: str = "optimal") -> tuple[DataFrame, DataFrame]:
    """W times c and H over c with c = (penalty of H / penalty of W) ** 1/4, one c (simple) or one a component (optimal); penalties of 0 make both 0."""
    if kind.upper() == "NONE":
        return w, h
    p = _penalties(v, w, h, rank, kind)
    fourth = lambda a, b: F.pow(ratio(a, b), F.lit(0.25))
    if method.lower() == "simple":
        one = p.agg(fourth(F.sum("ph"), F.sum("pw")).alias("c"))
        c = one.select(F.array(*([F.col("c")] * rank)).alias("c"))
    elif method.lower() == "optimal":
        c = p.agg(F.array(*(F.max(F.when(F.col("k") == k, fourth(F.col("ph"), F.col("pw")))) for k in range(rank))).alias("c"))
    else:
        raise ValueError(f"unknown method {method!r}: simple or optimal")
    up = lambda k: F.coalesce(F.col("w")[k] * F.col("c")[k], F.lit(0.0))
    down = lambda k: F.coalesce(ratio(F.col("h")[k], F.col("c")[k]), F.lit(0.0))
    c = F.broadcast(c)  # one row
    return w.join(c).select("i", each(rank, up).alias("w")), h.join(c).select("j", each(rank, down).alias("h"))
