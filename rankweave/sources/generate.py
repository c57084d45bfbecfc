"""Random matrices, factors and problems.

Cells are drawn by chunks of rows with seeds of their own; values and noise are drawn from
(seed, row, column) and factors from (seed, index, component): results do not depend on the cluster.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.specs import Distribution
from ..functions.vectors import dot, each
from ..model import MatrixMeta, Problem, Projected
from ..operators.reshape import frequent, noisy, random_submatrix
from ..session import ship


@dataclass(frozen=True)
class RandomMatrix:
    """A described random matrix: sizes, entries, rank, distributions and chunks."""

    size1: int
    size2: int
    nnz: int
    nnz_test: int = 0
    rank: int = 10
    values: str = "Normal(0,1)"
    noise: str = "Normal(0,0.1)"
    chunks: int = 8
    seed: int = 123

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> RandomMatrix:
        return cls(**json.loads(text))

    def chunk_sizes(self, nnz: int, salt: int) -> list[tuple[int, int, int, int]]:
        """(chunk, first row, rows, entries): entries fall to chunks by sequential binomials."""
        rng = np.random.default_rng([self.seed, salt])
        n = min(self.chunks, self.size1)
        edges = [self.size1 * c // n for c in range(n + 1)]
        out, left, cells = [], nnz, self.size1 * self.size2
        if nnz > cells:
            raise ValueError(f"{nnz} entries do not fit in {cells} cells")
        for c in range(n):
            rows = edges[c + 1] - edges[c]
            here = rows * self.size2
            take = left if c == n - 1 else int(rng.binomial(left, here / cells)) if cells else 0
            take = min(max(take, left - (cells - here)), here)  # what is left must fit in what is left
            out.append((c, edges[c], rows, take))
            left, cells = left - take, cells - here
        return out


def factor(spark: SparkSession, size: int, rank: int, distribution: str, seed: int, index: str = "i", vector: str = "w") -> DataFrame:
    """A random factor (index, vector) with i.i.d. entries."""
    d = Distribution.parse(distribution)
    return spark.range(size).select(F.col("id").alias(index), each(rank, lambda k: d.column(seed, F.col("id"), F.lit(k))).alias(vector))


def cells(spark: SparkSession, m: RandomMatrix, nnz: int, salt: int) -> DataFrame:
    """(i, j) of exactly ``nnz`` distinct cells."""
    ship(spark)
    plan = spark.createDataFrame(m.chunk_sizes(nnz, salt), "chunk long, first long, n long, take long").repartition(min(m.chunks, m.size1), "chunk")

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rng = np.random.default_rng([m.seed, salt, r["chunk"]])
                at = np.sort(rng.choice(r["n"] * m.size2, r["take"], replace=False, shuffle=False)) if r["take"] else np.zeros(0, np.int64)
                for a in range(0, len(at), 100_000):
                    part = at[a : a + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(r["first"] + part // m.size2), pa.array(part % m.size2)], names=["i", "j"])

    return plan.mapInArrow(run, "i long, j long")


def sparse(spark: SparkSession, m: RandomMatrix, distribution: str | None = None) -> DataFrame:
    """V(i, j, x) with i.i.d. values."""
    return cells(spark, m, m.nnz, 0).withColumn("x", Distribution.parse(distribution or m.values).column(m.seed, F.col("i"), F.col("j")))


def from_factors(at: DataFrame, w: DataFrame, h: DataFrame, rank: int) -> DataFrame:
    """Values of cells (i, j) from the product of factors."""
    return at.join(w, "i").join(h, "j").select("i", "j", dot("w", "h", rank).alias("x"))


def problem(spark: SparkSession, m: RandomMatrix, initial: str = "Uniform(-0.5,0.5)") -> tuple[Problem, DataFrame, DataFrame]:
    """Training data with noise, test data without, starting factors; and the planted factors."""
    w, h = factor(spark, m.size1, m.rank, m.values, m.seed + 1), factor(spark, m.size2, m.rank, m.values, m.seed + 2, "j", "h")
    train = noisy(from_factors(cells(spark, m, m.nnz, 0), w, h, m.rank), Distribution.parse(m.noise), m.seed + 3)
    test = from_factors(cells(spark, m, m.nnz_test, 1), w, h, m.rank) if m.nnz_test else None
    w0, h0 = factor(spark, m.size1, m.rank, initial, m.seed + 4), factor(spark, m.size2, m.rank, initial, m.seed + 5, "j", "h")
    return Problem(train, w0, h0, MatrixMeta(m.size1, m.size2), m.rank, test), w, h


def sample_sizes(meta: MatrixMeta, nnz: int, *, size: int | None = None, fraction: float | None = None, target_nnz: int | None = None) -> tuple[int, int]:
    """Rows and columns of a sample: a number of rows, a fraction, or about ``target_nnz`` entries."""
    if size is not None:
        return min(size, meta.size1), min(size, meta.size2)
    if fraction is not None:
        return max(1, int(meta.size1 * fraction)), max(1, int(meta.size2 * fraction))
    if target_nnz is None:
        raise ValueError("size, fraction or target_nnz")
    ratio = max(1, nnz // max(1, target_nnz))
    return max(1, int(meta.size1 / math.sqrt(ratio))), max(1, int(meta.size2 / math.sqrt(ratio)))


def prepare(v: DataFrame, meta: MatrixMeta, *, threshold: int = 0, seed: int = 1, **how) -> Projected:
    """A random submatrix of rows and columns with more than ``threshold`` entries."""
    n1, n2 = sample_sizes(meta, v.count(), **how)
    return frequent(random_submatrix(v, meta, n1, n2, seed), threshold)
