"""Totals of sparse matrices and factors; every one is a single partial and final aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import col


def nnz(v: DataFrame) -> DataFrame:
    return v.agg(F.count("*").alias("nnz"))


def total(v: DataFrame) -> DataFrame:
    return v.agg(F.sum("x").alias("total"))


def mean(v: DataFrame) -> DataFrame:
    return v.agg(F.avg("x").alias("mean"))


def nnz_of(v: DataFrame, axis: str, indexes: DataFrame | None = None) -> DataFrame:
    """(axis, nnz) for axis ``i`` or ``j``; with ``indexes``, also 0 for those without entries."""
    n = v.groupBy(axis).agg(F.count("*").alias("nnz"))
    return n if indexes is None else indexes.select(axis).join(n, axis, "left").select(axis, F.coalesce("nnz", F.lit(0)).alias("nnz"))


def nnz_max(v: DataFrame) -> DataFrame:
    """The largest number of entries of any row or column."""
    both = nnz_of(v, "i").select("nnz").union(nnz_of(v, "j").select("nnz"))
    return both.agg(F.coalesce(F.max("nnz"), F.lit(0)).alias("nnz_max"))


def absolute_sum(v: DataFrame) -> DataFrame:
    return v.agg(F.sum(F.abs("x")).alias("l1"))


def square_sum(v: DataFrame) -> DataFrame:
    return v.agg(F.sum(F.col("x") * F.col("x")).alias("l2"))


def _components(df: DataFrame, rank: int, name: str, f) -> DataFrame:
    """(k, name) from one aggregate of ``rank`` sums."""
    row = df.agg(*(F.sum(f(k)).alias(f"s{k}") for k in range(rank)))
    return row.select(F.posexplode(F.array(*(f"s{k}" for k in range(rank)))).alias("k", name))


def component_sums(df: DataFrame, vector: str, rank: int) -> DataFrame:
    """(k, total): sums of each component, the column sums of W or row sums of H."""
    return _components(df, rank, "total", lambda k: col(vector)[k])


def component_square_sums(df: DataFrame, vector: str, rank: int) -> DataFrame:
    return _components(df, rank, "total", lambda k: col(vector)[k] * col(vector)[k])


def weighted_square_sums(df: DataFrame, counts: DataFrame, index: str, vector: str, rank: int) -> DataFrame:
    """(k, total): squares weighted by the number of entries of the row or column."""
    return _components(df.join(counts, index), rank, "total", lambda k: F.col("nnz") * col(vector)[k] * col(vector)[k])


def vector_sums(df: DataFrame, index: str, vector: str, rank: int) -> DataFrame:
    """(index, total): sum over components of each row of W or column of H."""
    out = col(vector)[0]
    for k in range(1, rank):
        out = out + col(vector)[k]
    return df.select(index, out.alias("total"))


def gram(df: DataFrame, vector: str, rank: int) -> DataFrame:
    """(a, b, value) of W'W or HH': the upper half in one aggregation, then mirrored."""
    x = col(vector)
    row = df.agg(*(F.sum(x[a] * x[b]).alias(f"g{a}_{b}") for a in range(rank) for b in range(a, rank)))
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"g{min(a, b)}_{max(a, b)}").alias("value")) for a in range(rank) for b in range(rank)]
    return row.select(F.inline(F.array(*cells)))


def product_square_sum(w: DataFrame, h: DataFrame, rank: int) -> DataFrame:
    """Sum of squares of the product WH, from the two Gram matrices."""
    both = gram(w, "w", rank).withColumnRenamed("value", "g").join(gram(h, "h", rank), ["a", "b"])
    return both.agg(F.sum(F.col("g") * F.col("value")).alias("total"))


def product_sum(w: DataFrame, h: DataFrame, rank: int) -> DataFrame:
    """Sum of the product WH, from the component sums."""
    both = component_sums(w, "w", rank).withColumnRenamed("total", "g").join(component_sums(h, "h", rank), "k")
    return both.agg(F.sum(F.col("g") * F.col("total")).alias("total"))
