"""Column expressions on factor vectors.

All are unrolled over a rank known when the plan is built, so whole-stage code generation sees
plain arithmetic; higher-order functions would leave it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def each(rank: int, f: Callable[[int], Column]) -> Column:
    """The vector of ``f(0) .. f(rank - 1)``."""
    return F.array(*(f(k) for k in range(rank)))


def dot(w: str | Column, h: str | Column, rank: int, first: int = 0) -> Column:
    """Inner product from component ``first`` on, summed from the left."""
    w, h = col(w), col(h)
    out = F.lit(0.0)
    for n, k in enumerate(range(first, rank)):
        out = w[k] * h[k] if not n else out + w[k] * h[k]
    return out


def ratio(a: Column, b: Column) -> Column:
    """a / b where b is not 0; null elsewhere (ANSI division would fail)."""
    return a / F.when(b != 0, b)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 for what is not finite."""
    q = ratio(a, b)
    return F.when(q.isNull() | F.isnan(q) | (F.abs(q) == float("inf")), 0.0).otherwise(q)


def soft_truncate(x: Column, low: float, high: float, eps: float = 1e-8) -> Column:
    """Values at or beyond a bound move just inside it."""
    return F.when(x <= low, low + eps).when(x >= high, high - eps).otherwise(x)


def long(df: DataFrame, index: str, vector: str, value: str = "value") -> DataFrame:
    """(index, k, value): one row a component."""
    return df.select(index, F.posexplode(vector).alias("k", value))


def wide(df: DataFrame, index: str, rank: int, value: str = "value", vector: str = "w") -> DataFrame:
    """The inverse of :func:`long`; absent components are 0."""
    parts = [F.coalesce(F.max(F.when(F.col("k") == k, F.col(value))), F.lit(0.0)) for k in range(rank)]
    return df.groupBy(index).agg(F.array(*parts).alias(vector))
