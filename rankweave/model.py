"""Matrices as DataFrames, and what describes them.

A sparse matrix is ``V(i, j, x)`` with one row a stored cell; row factors are ``W(i, w)`` and column
factors ``H(j, h)`` with the vectors as arrays.  Indexes are 0-based longs, values doubles.  Absent
cells are unknown or zero as each operator says; the dense product is never formed.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

V_SCHEMA = T.StructType([T.StructField("i", T.LongType()), T.StructField("j", T.LongType()), T.StructField("x", T.DoubleType())])
W_SCHEMA = T.StructType([T.StructField("i", T.LongType()), T.StructField("w", T.ArrayType(T.DoubleType()))])
H_SCHEMA = T.StructType([T.StructField("j", T.LongType()), T.StructField("h", T.ArrayType(T.DoubleType()))])
NNZ_SCHEMA = T.StructType([T.StructField("index", T.LongType()), T.StructField("nnz", T.LongType())])


@dataclass(frozen=True)
class MatrixMeta:
    """Numbers of rows and columns."""

    size1: int
    size2: int


@dataclass(frozen=True)
class Blocking:
    """A cut of ``size`` indexes into ``blocks`` runs; the first ``size % blocks`` runs are one longer."""

    size: int
    blocks: int

    def __post_init__(self):
        if not 0 < self.blocks <= self.size:
            raise ValueError(f"cannot cut {self.size} indexes into {self.blocks} blocks")

    @property
    def offsets(self) -> list[int]:
        least, over = divmod(self.size, self.blocks)
        return [b * least + min(b, over) for b in range(self.blocks)]

    def block(self, index: Column) -> Column:
        """Block number of an index, by arithmetic alone."""
        least, over = divmod(self.size, self.blocks)
        cut = over * (least + 1)
        return F.when(index < cut, F.floor(index / (least + 1))).otherwise(over + F.floor((index - cut) / least)).cast("long")

    def start(self, block: Column) -> Column:
        """First index of a block."""
        least, over = divmod(self.size, self.blocks)
        return (block * least + F.least(block, F.lit(over))).cast("long")


@dataclass(frozen=True)
class Problem:
    """A factorization problem: data, factors, sizes and rank."""

    v: DataFrame
    w: DataFrame
    h: DataFrame
    meta: MatrixMeta
    rank: int
    test: DataFrame | None = None

    def __post_init__(self):
        for df, names in ((self.v, ("i", "j", "x")), (self.w, ("i", "w")), (self.h, ("j", "h"))):
            if missing := set(names) - set(df.columns):
                raise ValueError(f"columns {sorted(missing)} are missing")
        if self.rank < 1 or self.meta.size1 < 1 or self.meta.size2 < 1:
            raise ValueError("sizes and rank must be positive")

    def verified(self) -> Problem:
        """Itself, after one pass over indexes and vectors; unequal sizes raise."""
        e = self.v.agg(F.max("i").alias("i"), F.max("j").alias("j"), F.min(F.least("i", "j")).alias("low")).first()
        w = self.w.agg(F.max("i").alias("i"), F.min(F.size("w")).alias("a"), F.max(F.size("w")).alias("b"), F.count("*").alias("n")).first()
        h = self.h.agg(F.max("j").alias("i"), F.min(F.size("h")).alias("a"), F.max(F.size("h")).alias("b"), F.count("*").alias("n")).first()
        if e.low is not None and (e.low < 0 or e.i >= self.meta.size1 or e.j >= self.meta.size2):
            raise ValueError("an entry lies outside the matrix")
        for f, size in ((w, self.meta.size1), (h, self.meta.size2)):
            if f.n != size or f.i != size - 1 or f.a != self.rank or f.b != self.rank:
                raise ValueError("factors do not conform to the matrix and the rank")
        return self


class Projected(NamedTuple):
    """A submatrix, and the maps (new, old) of its rows and columns."""

    data: DataFrame
    map1: DataFrame
    map2: DataFrame
    meta: MatrixMeta | None = None
