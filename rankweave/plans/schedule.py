"""Which column block each row block meets in each sub-epoch; tables of d rows (sub-epochs) by d (row blocks)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDERS = ("SEQ", "RSEQ", "WR", "WOR", "COWOR")


def sequential(spark: SparkSession, d: int) -> DataFrame:
    """(sub_epoch, b1, b2) of the sequential schedule, as a query."""
    return spark.range(d).select(F.col("id").alias("sub_epoch")).join(spark.range(d).select(F.col("id").alias("b1"))).withColumn("b2", (F.col("sub_epoch") + F.col("b1")) % d)  # d * d rows of a parameter


def stratum_schedule(order: str, d: int, rng: np.random.Generator, group: int = 1) -> np.ndarray:
    """A d x d table.  In all but WR each column block meets each row block once an epoch."""
    seq = (np.arange(d)[:, None] + np.arange(d)[None, :]) % d
    order = order.upper()
    if order == "SEQ":
        return seq
    if order == "RSEQ":
        return rng.permutation(d)[seq]
    if order == "WR":
        return np.stack([rng.permutation(d) for _ in range(d)])
    if order == "WOR":
        return seq[rng.permutation(d)][:, rng.permutation(d)]
    if order == "COWOR":  # groups of row blocks keep a group of column blocks, drawn anew each time, for ``group`` sub-epochs
        if d % group:
            raise ValueError(f"{d} blocks do not fall into groups of {group}")
        outer = stratum_schedule("WOR", d // group, rng)
        out = np.empty((d, d), int)
        for s in range(d // group):
            for g in range(d // group):
                inner = stratum_schedule("WOR", group, rng)
                out[s * group : (s + 1) * group, g * group : (g + 1) * group] = outer[s, g] * group + inner
        return rng.permutation(d)[out]
    raise ValueError(f"unknown order {order!r}: one of {', '.join(ORDERS)}")


def overlapped_schedule(d: int, rng: np.random.Generator) -> np.ndarray:
    """A 2d x d table over 2d column blocks: even sub-epochs use a random half, odd ones the other, so neighbours share none."""
    blocks = rng.permutation(2 * d)
    even, odd = blocks[:d], blocks[d:]
    a, b = (stratum_schedule("WOR", d, rng) for _ in range(2))
    out = np.empty((2 * d, d), int)
    out[0::2], out[1::2] = even[a], odd[b]
    return out


def schedule_table(spark: SparkSession, order: str, d: int, seed: int = 1, group: int = 1) -> DataFrame:
    """(sub_epoch, b1, b2) of any order, or of the overlapped schedule with its 2d column blocks."""
    rng = np.random.default_rng(seed)
    t = overlapped_schedule(d, rng) if order.upper() == "OVERLAPPED" else stratum_schedule(order, d, rng, group)
    return spark.createDataFrame([(s, b1, int(b2)) for s, line in enumerate(t) for b1, b2 in enumerate(line)], "sub_epoch long, b1 long, b2 long")
