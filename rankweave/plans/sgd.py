"""Stratified stochastic gradient descent.

Entries are cut into blocks (b1, b2) once and kept as rows of three arrays; factors as one row a
block.  In a sub-epoch every row block meets one column block, as a schedule says, and no two
meet the same; so blocks run side by side and the result is that of some serial order.  Up to
``CUT`` sub-epochs are one job: each deals the factor blocks anew, and each data block moves once.
Seeds are of (seed, epoch, b1, b2): results do not depend on the cluster.

A block with more than ``PART`` entries is kept in parts, which a task takes one after another: it holds
the factor blocks that it works on and one part, whatever the size of the block.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Blocking, Problem
from ..operators import aggregate as A
from ..operators.reshape import with_blocks
from . import kernels, local
from .schedule import overlapped_schedule, stratum_schedule
from .store import Tables

FACTOR_SQL = "side string, b long, flat binary, n binary"
#: Regularizers that act inside each stratum, on the blocks it touches, with a step divided by the number of strata.
PER_STRATUM = ("L1", "L2", "Nzl2")
#: Updates that need the numbers of entries of rows and columns.
COUNTED = ("Nzsl_L2", "Nzsl_L1")
#: Sub-epochs of one job.
CUT = 16
#: Entries of a part of a block, on average at most.
PART = 250_000


@dataclass(frozen=True)
class Rule:
    """Update name and arguments, order of entries, what each step ends with, and the regularizer of each stratum (name and arguments)."""

    kind: str = "Nzsl"
    args: tuple = ()
    order: str = "WOR"
    abs_: bool = False
    truncate: tuple | None = None
    max_norm: float | None = None
    regularizer: tuple[str, tuple] = ("None", ())
    cells: int = 1


def _table(rows: list[dict]) -> pa.Table:
    kinds = {"side": pa.string(), "b": pa.int64(), "flat": pa.binary(), "n": pa.binary()}
    return pa.table({c: pa.array([r[c] for r in rows], t) for c, t in kinds.items()})


def _to_blocks(df: DataFrame, index: str, vector: str, blocking: Blocking, side: str, counts: DataFrame | None = None) -> DataFrame:
    """(side, b, flat, n): the vectors of each block end to end, in index order, and their numbers of entries if wanted."""
    df = df.select(index, vector)
    if counts is not None:
        df = df.join(counts, index, "left").withColumn("nnz", F.coalesce("nnz", F.lit(0)))

    def run(key, own):
        own = own.sort_by(index)
        flat = own.column(vector).combine_chunks().flatten().to_numpy().astype(np.float64).tobytes()
        n = own.column("nnz").to_numpy().astype(np.int32).tobytes() if "nnz" in own.column_names else None
        return _table([{"side": side, "b": key[0].as_py(), "flat": flat, "n": n}])

    return df.withColumn("b", blocking.block(F.col(index))).groupBy("b").applyInArrow(run, FACTOR_SQL)


def from_blocks(blocks: DataFrame, side: str, blocking: Blocking, rank: int, index: str, vector: str) -> DataFrame:
    """Block rows as (index, vector) again."""
    offsets = blocking.offsets

    def run(batches):
        for batch in batches:
            for b, flat in zip(batch.column("b").to_pylist(), batch.column("flat").to_pylist()):
                x = np.frombuffer(flat)
                n = len(x) // rank
                yield pa.RecordBatch.from_arrays([pa.array(offsets[b] + np.arange(n)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * rank), pa.array(x))], names=[index, vector])

    return blocks.filter(F.col("side") == side).mapInArrow(run, f"{index} long, {vector} array<double>")


class Stratified:
    """Blocked data and factors of a problem; ``epoch`` runs one pass."""

    def __init__(self, problem: Problem, rule: Rule, d: int, d2: int | None = None, tables: Tables | None = None):
        self.problem, self.rule = problem, rule
        self.rows, self.cols = Blocking(problem.meta.size1, d), Blocking(problem.meta.size2, d2 or d)
        self.tables = tables or Tables(problem.v.sparkSession)
        rows, cols = self.rows.offsets, self.cols.offsets
        v = with_blocks(problem.v.select("i", "j", "x"), self.rows, self.cols)
        self.parts = max(1, math.ceil(problem.v.count() / (len(rows) * len(cols) * PART)))
        v = v.withColumn("part", self._part())

        def pack(key, own):
            own = own.sort_by([("i", "ascending"), ("j", "ascending")])
            b1, b2, part = (k.as_py() for k in key)
            get = lambda c: own.column(c).to_numpy()
            flat = {"i": (get("i") - rows[b1]).astype(np.int32), "j": (get("j") - cols[b2]).astype(np.int32), "x": get("x").astype(np.float64)}
            return pa.table({"b1": pa.array([b1], pa.int64()), "b2": pa.array([b2], pa.int64()), "part": pa.array([part], pa.int32()), **{c: pa.array([a.tobytes()], pa.binary()) for c, a in flat.items()}})

        self.data = self.tables.put(v.groupBy("b1", "b2", "part").applyInArrow(pack, "b1 long, b2 long, part int, i binary, j binary, x binary"), by=("b1", "b2"))
        weighted = rule.regularizer[0] == "Nzl2"
        self.most = A.nnz_max(problem.v).first()[0] if weighted else 0
        self.set_factors(problem.w, problem.h)

    def _part(self):
        """Parts by a hash, so that one after another in random order is a random order; by row where entries are taken in order or by squares."""
        if self.parts == 1:
            return F.lit(0)
        if self.rule.order == "WOR" and self.rule.cells == 1:
            return F.pmod(F.xxhash64("i", "j", F.lit(53)), F.lit(self.parts)).cast("int")
        b1, least = F.col("b1"), max(1, self.rows.size // self.rows.blocks)
        n = least + F.when(b1 < self.rows.size % self.rows.blocks, 1).otherwise(0)
        band = self.rule.cells if self.rule.cells > 1 else least  # whole squares, or rows
        return F.least(F.floor(F.floor((F.col("i") - self.rows.start(b1)) * band / n) * min(self.parts, band) / band), F.lit(self.parts - 1)).cast("int")

    def meet(self, factors: DataFrame, meets: np.ndarray, eps: float, seeds: list[tuple]) -> DataFrame:
        """New factors after row block b1 met column blocks ``meets[0][b1]``, ``meets[1][b1]`` and so on; other column blocks pass as they are.

        Factor blocks are dealt to the row block they meet, and so are the parts of the data blocks it
        needs, in one exchange.  Row block b1 is partition b1, so no two share a task, and a column
        block meets one row block alone.
        """
        rank, rule, d, most, parts = self.problem.rank, self.rule, self.rows.blocks, self.most, self.parts
        hosts = [[] for _ in range(self.cols.blocks)]
        for b1, own in enumerate(meets.T.tolist()):
            for b in dict.fromkeys(own):
                hosts[b].append(b1)
        hosts = [own or [b % d] for b, own in enumerate(hosts)]
        listed = lambda lists, at: F.split(F.element_at(F.split(F.lit(";".join(" ".join(map(str, x)) for x in lists)), ";"), (at + 1).cast("int")), " ")  # noqa: E731 (two literals, however many blocks)
        to = F.when(F.col("side") == "w", F.col("b").cast("int")).otherwise(listed(hosts, F.col("b"))[0].cast("int"))
        left = factors.select(to.alias("key"), F.lit(0).cast("long").alias("turn"), F.lit(0).cast("long").alias("place"), F.lit(0).alias("part"), "side", "b", "flat", "n", F.lit(None).cast("binary").alias("j"))
        met = listed(meets.T.tolist(), F.col("b1"))
        mine = self.data.filter(F.array_contains(met, F.col("b2").cast("string")))  # on folders: the files of these blocks alone are opened
        place = F.col("part").cast("long") if rule.order == "SEQ" else F.xxhash64("part", F.lit(" ".join(map(str, seeds[0]))))
        right = mine.select(F.col("b1").cast("int").alias("key"), F.array_position(met, F.col("b2").cast("string")).alias("turn"), place.alias("place"), "part", F.lit("v").alias("side"), F.col("b2").alias("b"), F.col("x").alias("flat"), F.col("i").alias("n"), "j")

        def counts(row, size):
            return np.maximum(np.frombuffer(row["n"], np.int32), 1) if row["n"] is not None else np.ones(size, np.int32)

        def run(batches):
            turns = itertools.groupby((r for batch in batches for r in batch.to_pylist()), lambda r: r["turn"])
            first = next(turns, None)
            if first is None:
                return
            at = {(r["side"], r["b"]): r for r in first[1]}
            k, w = next((b, r) for (side, b), r in at.items() if side == "w")
            wv = np.frombuffer(w["flat"]).reshape(-1, rank).copy()
            per_w = counts(w, len(wv))
            waiting = next(turns, None)
            for turn, (b, seed) in enumerate(zip(meets[:, k].tolist(), seeds), 1):
                h = at["h", b]
                hv = np.frombuffer(h["flat"]).reshape(-1, rank).copy()
                if waiting is not None and waiting[0] == turn:
                    per_h = counts(h, len(hv))
                    for v in waiting[1]:
                        i, j = (np.frombuffer(v[c], np.int32).astype(np.int64) for c in ("n", "j"))
                        rng = np.random.default_rng([*seed, k, b] + [v["part"]] * (parts > 1))
                        kernels.epoch(rule.kind, rule.args, i, j, np.frombuffer(v["flat"]), wv, hv, eps, rng, per_w, per_h, rule.order, rule.abs_, rule.truncate, rule.max_norm, rule.cells)
                    waiting = next(turns, None)
                name, args = rule.regularizer
                if name in PER_STRATUM:
                    n = (np.frombuffer(x["n"], np.int32) if x["n"] is not None else None for x in (w, h))
                    wv, hv = local.regularize(name, args, wv, hv, eps / d, *n, most)
                h["flat"] = hv.tobytes()
            w["flat"] = wv.tobytes()
            for row in at.values():
                yield from _table([row]).to_batches()

        return left.union(right).repartitionById(d, F.col("key")).sortWithinPartitions("turn", "place").mapInArrow(run, FACTOR_SQL)

    def plan(self, number: int, seed: int, order: str = "COWOR", group: int = 1) -> np.ndarray:
        """Which column block each row block meets in each sub-epoch of an epoch."""
        rng = np.random.default_rng([seed, number])
        return overlapped_schedule(self.rows.blocks, rng) if self.cols.blocks == 2 * self.rows.blocks else stratum_schedule(order, self.rows.blocks, rng, group)

    def epoch(self, number: int, eps: float, seed: int, order: str = "COWOR", group: int = 1) -> None:
        """All sub-epochs of one pass; its end is written, and every ``CUT`` exchanges, so that plans and what a lost executor repeats stay bounded.

        Sub-epochs in a row that share no column block need one exchange: of twice as many column
        blocks as row blocks, a half is at work while the other moves, so there are half as many.
        """
        plan = self.plan(number, seed, order, group)
        factors, done = self.factors, 0
        for first, last in disjoint(plan):
            factors = self.meet(factors, plan[first:last], eps, [(seed, number, s) for s in range(first, last)])
            done += 1
            if done % CUT == 0 and last < len(plan):
                factors = self.tables.put(factors, plain=True)
        self.factors = self.tables.put(factors, plain=True)

    def set_factors(self, w: DataFrame, h: DataFrame) -> None:
        counts = [A.nnz_of(self.problem.v, axis) if self.rule.regularizer[0] == "Nzl2" or self.rule.kind in COUNTED else None for axis in ("i", "j")]
        self.factors = self.tables.put(_to_blocks(w, "i", "w", self.rows, "w", counts[0]).union(_to_blocks(h, "j", "h", self.cols, "h", counts[1])))

    def w(self) -> DataFrame:
        return from_blocks(self.factors, "w", self.rows, self.problem.rank, "i", "w")

    def h(self) -> DataFrame:
        return from_blocks(self.factors, "h", self.cols, self.problem.rank, "j", "h")


def disjoint(plan: np.ndarray) -> list[tuple[int, int]]:
    """Runs (first, past the last) of sub-epochs in which no column block is met twice."""
    out, first, met = [], 0, set()
    for s, line in enumerate(plan.tolist()):
        if met & set(line):
            out.append((first, s))
            first, met = s, set()
        met |= set(line)
    return [*out, (first, len(plan))]


def _added(share: float):
    """Column blocks and ``share`` of the changes of all their new versions (side "d"), added up."""

    def add(key, own):
        old = next(np.frombuffer(f) for s, f in zip(own.column("side").to_pylist(), own.column("flat")) for f in [f.as_py()] if s == "h")
        total = old.copy()
        for s, f in zip(own.column("side").to_pylist(), own.column("flat")):
            if s == "d":
                total += (np.frombuffer(f.as_py()) - old) * share
        n = next((n for n in own.column("n").to_pylist() if n is not None), None)
        return _table([{"side": "h", "b": key[0].as_py(), "flat": total.tobytes(), "n": n}])

    return add


def asynchronous_round(run: Stratified, eps: float, seed: tuple, average: bool = False, staleness: int | None = None) -> None:
    """One round of delta exchange, in which a row block works on copies of H that are at most ``staleness`` steps old (None: a round).

    In step t row block b1 works on column block (b1 + t) mod d.  Every ``staleness + 1`` steps the
    changes of each column block are summed or averaged into a new version of it.  Until then each
    step starts from the version before and its outcome is kept beside it, so a task holds one row
    block and one column block, whatever the size of H.  With a staleness of 0 no two
    row blocks work on one column block at a time, and the round is that of some serial order.
    """
    d = run.rows.blocks
    span = d if staleness is None else min(staleness + 1, d)
    plan = (np.arange(d)[:, None] + np.arange(d)[None, :]) % d
    factors = run.factors
    for first in range(0, d, span):
        steps = range(first, min(first + span, d))
        if len(steps) == 1:
            factors = run.meet(factors, plan[first : first + 1], eps, [(*seed, first)])
            continue
        if first:
            factors = run.tables.put(factors, plain=True)
        w, old = factors.filter("side = 'w'"), factors.filter("side = 'h'")
        every = old
        for s in steps:
            done = run.tables.put(run.meet(w.union(old), plan[s : s + 1], eps, [(*seed, s)]), plain=True)
            w, every = done.filter("side = 'w'"), every.union(done.filter("side = 'h'").withColumn("side", F.lit("d")))
        factors = run.tables.put(w.union(every.groupBy("b").applyInArrow(_added(1 / len(steps) if average else 1.0), FACTOR_SQL)))
    run.factors = run.tables.put(factors, plain=True)
