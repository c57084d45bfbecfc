"""Scaling and element-wise arithmetic of factors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import col, dot, each, ratio, safe_ratio, soft_truncate


def _with(df: DataFrame, vector: str, rank: int, f) -> DataFrame:
    return df.withColumn(vector, each(rank, f))


def times(df: DataFrame, vector: str, rank: int, c: float) -> DataFrame:
    return _with(df, vector, rank, lambda k: col(vector)[k] * c)


def divided(df: DataFrame, vector: str, rank: int, c: float) -> DataFrame:
    if c == 0:
        raise ZeroDivisionError("a factor divided by 0")
    return _with(df, vector, rank, lambda k: col(vector)[k] / c)


def times_components(df: DataFrame, vector: str, rank: int, c: Sequence[float] | Sequence[Column]) -> DataFrame:
    """Component k times c[k]: columns of W, rows of H."""
    return _with(df, vector, rank, lambda k: col(vector)[k] * c[k])


def divided_components(df: DataFrame, vector: str, rank: int, c: Sequence[float]) -> DataFrame:
    return _with(df, vector, rank, lambda k: col(vector)[k] / c[k])


def times_index(df: DataFrame, index: str, vector: str, rank: int, by: DataFrame) -> DataFrame:
    """Each row of W (column of H) times the ``c`` of its index in ``by`` (index, c)."""
    return _with(df.join(by.select(index, "c"), index), vector, rank, lambda k: col(vector)[k] * F.col("c")).drop("c")


def divided_index(df: DataFrame, index: str, vector: str, rank: int, by: DataFrame) -> DataFrame:
    return _with(df.join(by.select(index, "c"), index), vector, rank, lambda k: ratio(col(vector)[k], F.col("c"))).drop("c")


def quotient0(a: DataFrame, b: DataFrame, index: str, vector: str, rank: int) -> DataFrame:
    """Element-wise a / b, 0 where that is not finite."""
    both = a.join(b.select(index, F.col(vector).alias("other")), index)
    return _with(both, vector, rank, lambda k: safe_ratio(col(vector)[k], F.col("other")[k])).drop("other")


def hadamard(a: DataFrame, b: DataFrame, index: str, vector: str, rank: int) -> DataFrame:
    both = a.join(b.select(index, F.col(vector).alias("other")), index)
    return _with(both, vector, rank, lambda k: col(vector)[k] * F.col("other")[k]).drop("other")


def absolute(df: DataFrame, vector: str, rank: int) -> DataFrame:
    return _with(df, vector, rank, lambda k: F.abs(col(vector)[k]))


def truncated(df: DataFrame, vector: str, rank: int, low: float, high: float, eps: float = 1e-8) -> DataFrame:
    return _with(df, vector, rank, lambda k: soft_truncate(col(vector)[k], low, high, eps))


def cosine(a: Column | str, b: Column | str, rank: int) -> Column:
    """Cosine of two vectors, 0 if either is 0."""
    return F.coalesce(ratio(dot(a, b, rank), F.sqrt(dot(a, a, rank)) * F.sqrt(dot(b, b, rank))), F.lit(0.0))
