"""Parallel stochastic gradient descent on one copy of the factors.

The points of a pass are permuted anew each epoch and cut into mini-batches, and the points of a
mini-batch are dealt to tasks without regard to rows and columns, so any task may change any vector.
A task starts from the factors as the mini-batch found them, takes its points one after another, and
hands back what it changed; changes of one vector by several tasks add up.  With one task this is
sequential descent, with as many tasks as points it is one step along the summed gradient.

A point's place in the permutation is a hash of (seed, epoch, row, column), so the next permutation
is ready when an epoch ends without a buffer, and no task sorts more than its own points.  A task
holds the vectors that its points touch, once each, and ``HELD`` of its points at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import draws
from ..model import Problem
from ..operators import aggregate as A
from ..session import ship
from . import kernels
from .store import Tables

CHANGES = pa.schema([("side", pa.string()), ("id", pa.int64()), ("delta", pa.list_(pa.float64()))])
#: Points of a task that are taken together; the rest follow them.
HELD = 500_000
CHANGES_SQL = "side string, id long, delta array<double>"


def dealt(v: DataFrame, seed: int, epoch: int, tasks: int, batches: int, order: str = "WOR") -> DataFrame:
    """``v`` with ``place`` (0 to 1) in the epoch's permutation, ``batch``, and ``task``.

    WOR: mini-batches are ranges of places and so are the tasks' parts of them.  SEQ: the places
    follow the points' keys, so that points in one row stay together.
    """
    place = draws.uniform(seed, F.lit(epoch), *(F.col(c) for c in (("i", "j") if order == "WOR" else ("i",))))
    at = F.least(F.floor(place * (tasks * batches)), F.lit(tasks * batches - 1)).cast("int")
    return v.withColumn("place", place).withColumn("batch", F.floor(at / tasks).cast("int")).withColumn("task", at % tasks)


def changes(points: DataFrame, w: DataFrame, h: DataFrame, rule, eps: float, seed: tuple, tasks: int) -> DataFrame:
    """(side, id, delta): what each ``task`` of a mini-batch changes, starting from ``w`` and ``h``."""

    ship(points.sparkSession)
    zero, none = F.lit(0).cast("long"), F.array().cast("array<double>")
    like = {"task": F.col("task"), "place": F.lit(0.0), "i": zero, "j": zero, "x": F.lit(0.0), "n1": zero, "n2": zero, "vector": none}
    rows = points.select(F.lit(2).alias("turn"), *(F.col(c).cast("double").alias(c) if c == "x" else none.alias(c) if c == "vector" else F.col(c) for c in like))
    for turn, (factor, c, vector) in enumerate(((w, "i", "w"), (h, "j", "h"))):
        touched = points.select("task", c).distinct().join(factor, c)
        rows = rows.union(touched.select(F.lit(turn).alias("turn"), *(x.alias(k) for k, x in (like | {c: F.col(c), "vector": F.col(vector)}).items())))

    def run(batches):
        found, held, n, state = ([], []), [], 0, None

        def take():
            (rows, wv, per_w, _), (cols, hv, per_h, _) = state
            i, j, x, n1, n2 = (np.concatenate(c) for c in zip(*held))
            i, j = np.searchsorted(rows, i), np.searchsorted(cols, j)
            per_w[i], per_h[j] = n1, n2
            order = "WR" if rule.order == "WR" else "SEQ"  # places are the permutation
            kernels.epoch(rule.kind, rule.args, i, j, x, wv, hv, eps, rng, per_w, per_h, order, rule.abs_, rule.truncate, rule.max_norm)

        for batch in batches:  # vectors of both sides by id, then points by place
            if n == 0 and state is None:
                rng = np.random.default_rng([*seed, batch.column("task")[0].as_py()])
            turn = batch.column("turn").to_numpy()
            cuts = np.searchsorted(turn, [0, 1, 2, 3])
            for side, c in enumerate(("i", "j")):
                if own := int(cuts[side + 1] - cuts[side]):
                    part = batch.slice(int(cuts[side]), own)
                    found[side].append((part.column(c).to_numpy(), part.column("vector").flatten().to_numpy().reshape(own, -1)))
            if own := int(cuts[3] - cuts[2]):
                if state is None:
                    state = []
                    for side in found:
                        v = np.concatenate([x for _, x in side])
                        state.append((np.concatenate([k for k, _ in side]), v, np.ones(len(v)), v.copy()))
                        side.clear()
                held.append([batch.slice(int(cuts[2]), own).column(c).to_numpy() for c in ("i", "j", "x", "n1", "n2")])
                n += own
                if n >= HELD:
                    take()
                    held, n = [], 0
        if n:
            take()
        for side, (ids, new, _, was) in zip("wh", state or ()):
            for first in range(0, len(ids), 100_000):
                delta = new[first : first + 100_000] - was[first : first + 100_000]
                size = pa.array(np.arange(len(delta) + 1, dtype=np.int32) * new.shape[1])
                yield pa.record_batch([pa.array([side] * len(delta)), pa.array(ids[first : first + len(delta)]), pa.ListArray.from_arrays(size, pa.array(delta.ravel()))], schema=CHANGES)

    return rows.repartitionById(tasks, F.col("task").cast("int")).sortWithinPartitions("turn", "place", "i", "j").mapInArrow(run, CHANGES_SQL)


def moved(factor: DataFrame, index: str, vector: str, found: DataFrame, side: str, rank: int, rule) -> DataFrame:
    """The factor with all changes of its side added, and the rule's bounds kept."""
    mine = found.filter(F.col("side") == side).groupBy(F.col("id").alias(index)).agg(*(F.sum(F.col("delta")[k]).alias(f"d{k}") for k in range(rank)))
    new = [F.col(vector)[k] + F.coalesce(f"d{k}", F.lit(0.0)) for k in range(rank)]
    if rule.truncate:
        low, high = rule.truncate
        new = [F.greatest(F.least(x, F.lit(high - 1e-8)), F.lit(low + 1e-8)) for x in new]
    if rule.abs_:
        new = [F.abs(x) for x in new]
    return factor.join(mine, index, "left").select(index, F.array(*new).alias(vector))


def epoch(problem: Problem, w: DataFrame, h: DataFrame, rule, eps: float, seed: int, number: int, tasks: int, batches: int, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Both factors after one pass over all points in ``batches`` mini-batches of ``tasks`` tasks."""
    v = problem.v.select("i", "j", "x")
    if rule.kind in ("Nzsl_L2", "Nzsl_L1"):
        v = v.join(A.nnz_of(problem.v, "i").withColumnRenamed("nnz", "n1"), "i").join(A.nnz_of(problem.v, "j").withColumnRenamed("nnz", "n2"), "j")
    else:
        v = v.withColumns({"n1": F.lit(1).cast("long"), "n2": F.lit(1).cast("long")})
    points = tables.put(dealt(v, seed, number, tasks, batches, rule.order), by=("batch",))
    for k in range(batches):
        found = tables.put(changes(points.filter(F.col("batch") == k), w, h, rule, eps, (seed, number, k), tasks))
        w, h = tables.put(moved(w, "i", "w", found, "w", problem.rank, rule)), tables.put(moved(h, "j", "h", found, "h", problem.rank, rule))
    return w, h
