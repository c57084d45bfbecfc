"""Alternating least squares: each half step is one join, one aggregation and a stack of small solves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.linear import least_squares_many
from ..session import ship


def half_step(v: DataFrame, fixed: DataFrame, old: DataFrame, rank: int, *, side: str = "w", lam: float = 0.0, weighted: bool = False) -> DataFrame:
    """New W from H (side ``w``) or new H from W (side ``h``).

    Normal equations are r(r+1)/2 + r sums a row, aggregated before the shuffle; the penalty is
    lam, or lam times the number of entries if ``weighted``.  Singular systems take the solution of
    least norm.  Rows without entries keep their old vector.
    """
    ship(v.sparkSession)
    index, other, fc, oc = ("i", "j", "h", "w") if side == "w" else ("j", "i", "w", "h")
    f = F.col(fc)
    sums = [F.sum(f[a] * f[b]).alias(f"a{a}_{b}") for a in range(rank) for b in range(a, rank)] + [F.sum(F.col("x") * f[k]).alias(f"b{k}") for k in range(rank)]
    normal = v.join(fixed.select(other, fc), other).groupBy(index).agg(F.count("*").alias("n"), *sums)

    def solve(batches):
        upper = [(a, b) for a in range(rank) for b in range(a, rank)]
        for batch in batches:
            n = batch.num_rows
            a = np.empty((n, rank, rank))
            for p, q in upper:
                a[:, p, q] = a[:, q, p] = batch.column(f"a{p}_{q}").to_numpy(zero_copy_only=False)
            b = np.column_stack([batch.column(f"b{k}").to_numpy(zero_copy_only=False) for k in range(rank)]) if n else np.empty((0, rank))
            penalty = lam * (batch.column("n").to_numpy(zero_copy_only=False) if weighted else np.ones(n))
            a[:, np.arange(rank), np.arange(rank)] += penalty[:, None]
            x = least_squares_many(a, b) if n else b
            values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * rank), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(index), values], names=[index, "new"])

    new = normal.mapInArrow(solve, f"{index} long, new array<double>")
    return old.select(index, oc).join(new, index, "left").select(index, F.coalesce("new", oc).alias(oc))
