"""One entry point for every factorization method: a spec of names and numbers, an epoch loop, and a trace."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import decay as D
from ..functions import draws
from ..functions.specs import parse
from ..model import Problem
from ..operators import loss as L
from ..operators import regularize as R
from ..operators.balance import balanced
from . import als, kernels, local, multiplicative, parallel, sgd
from .store import Tables, clean_shuffles

METHODS = ("sgd", "psgd", "csgd", "dsgd", "overlapped", "asgd", "als", "gnmf", "lee")
#: Combinations of update, regularizer and loss that descend the loss they report.
VALID = {
    ("Nzsl", "None", "Nzsl"), ("Nzsl_L2", "None", "Nzsl_L2"), ("Nzsl_Nzl2", "None", "Nzsl_Nzl2"), ("Nzsl_L1", "None", "Nzsl_L1"),
    ("Nzsl", "L2", "Nzsl_L2"), ("Nzsl", "Nzl2", "Nzsl_Nzl2"), ("Nzsl", "L1", "Nzsl_L1"), ("Biased", "None", "Biased"),
    ("Sl", "Sl", "Sl"), ("Gkl", "Gkl", "Gkl"),
}


#: Entries that a block has on average at most where the number of blocks is not given, and those that one task may take.
BLOCK_ENTRIES, ONE_TASK = 4_000_000, 1_000_000_000


@dataclass(frozen=True)
class Spec:
    """What to run.

    ``blocks`` is the number of strata, whatever the cluster; 0 takes 4, or more where a block would have
    over ``BLOCK_ENTRIES``.  ``psgd`` deals the points of each of ``batches`` mini-batches to ``blocks`` tasks
    that share one copy of the factors, ``csgd`` visits each stratum by squares that fit ``cache_kb`` of
    cache, ``overlapped`` has twice as many column blocks as row blocks, and ``asgd`` works on factors
    that are at most ``staleness`` steps old (-1: a round).  ``sgd`` is one block and so one task: more
    than ``ONE_TASK`` entries are refused.
    """

    method: str = "dsgd"
    update: str = "Nzsl"
    regularize: str = "None"
    loss: str = "Nzsl"
    decay: str = "BoldDriver(0.001)"
    epochs: int = 10
    blocks: int = 0
    order: str = "WOR"
    strata: str = "COWOR"
    group: int = 1
    balance: str = "None"
    balance_method: str = "optimal"
    abs_: bool = False
    truncate: tuple | None = None
    max_norm: float | None = None
    average: bool = False
    seed: int = 1
    cache_kb: float = 256
    batches: int = 4
    staleness: int = -1

    def checked(self) -> Spec:
        if self.method not in METHODS:
            raise ValueError(f"unknown method {self.method!r}: one of {', '.join(METHODS)}")
        if self.method in ("als", "gnmf", "lee"):
            kinds = {"als": ("Nzsl", "Nzsl_L2", "Nzsl_Nzl2"), "gnmf": ("Sl",), "lee": ("Gkl",)}[self.method]
            if parse(self.loss).name not in kinds:
                raise ValueError(f"{self.method} minimizes {' or '.join(kinds)}")
            return self
        triple = (parse(self.update).name, parse(self.regularize).name, parse(self.loss).name)
        if triple not in VALID:
            raise ValueError(f"update, regularizer and loss do not fit: {triple}")
        if self.method == "overlapped" and triple[1] != "None":
            raise ValueError("the overlapped schedule has no separate regularizer")
        return self


@dataclass
class Result:
    w: DataFrame
    h: DataFrame
    trace: DataFrame


def loss_of(name: str, v, w, h, rank: int) -> DataFrame:
    """The loss of a spec such as ``Nzsl_L2(0.05)``."""
    s = parse(name)
    if s.name == "Nzsl":
        return L.squared(v, w, h, rank)
    if s.name == "Nzsl_L2":
        return L.summed(L.squared(v, w, h, rank), L.l2(w, h, rank, *s.args))
    if s.name == "Nzsl_L1":
        return L.summed(L.squared(v, w, h, rank), L.l1(w, h, rank, *s.args))
    if s.name == "Nzsl_Nzl2":
        return L.summed(L.squared(v, w, h, rank), L.weighted_l2(v, w, h, rank, *s.args))
    if s.name == "Biased":
        return L.summed(L.biased_squared(v, w, h, rank), L.biased_weighted_l2(v, w, h, rank, *s.args)) if s.args and any(s.args) else L.biased_squared(v, w, h, rank)
    if s.name in ("Sl", "Gkl", "NzRmse", "Kl"):
        return {"Sl": L.full_squared, "Gkl": L.gkl, "NzRmse": L.rmse, "Kl": L.kl}[s.name](v, w, h, rank)
    raise ValueError(f"unknown loss {name!r}")


def regularizer_of(name: str) -> R.Regularizer:
    s = parse(name)
    kinds = {"None": R.none, "L1": R.l1, "L2": R.l2, "Nzl2": R.nzl2, "Sl": R.full_squared, "Gkl": R.gkl}
    if s.name not in kinds:
        raise ValueError(f"unknown regularizer {name!r}")
    return kinds[s.name](*s.args)


def _value(df: DataFrame) -> float:
    return df.first()[0]


def factorize(problem: Problem, spec: Spec) -> Result:
    """Run ``spec`` on ``problem``: factors after the last epoch and a trace with one row an epoch (epoch 0: the start).

    In alternating methods an epoch updates one factor: ALS and Lee start with W, GNMF with H.
    """
    spec = spec.checked()
    with clean_shuffles(problem.v.sparkSession):
        return _factorized(problem, spec)


def _factorized(problem: Problem, spec: Spec) -> Result:
    spark, rank = problem.v.sparkSession, problem.rank
    tables = Tables(spark)
    problem = replace(problem, v=tables.put(problem.v.select("i", "j", "x"))).verified()  # every epoch reads it
    test_loss = "Biased" if parse(spec.loss).name == "Biased" else "Nzsl"
    began, rows = time.time(), []

    def note(epoch, w, h, eps, took):
        t = time.time()
        loss = _value(loss_of(spec.loss, problem.v, w, h, rank))
        t_loss, t = time.time() - t, time.time()
        test = _value(loss_of(test_loss, problem.test, w, h, rank)) if problem.test is not None else float("nan")
        rows.append(((epoch + 1) // 2 if spec.method in ("als", "gnmf", "lee") else epoch, epoch, loss, test, eps, time.time() - began, took, t_loss, time.time() - t))
        return loss

    w, h = tables.put(problem.w.select("i", "w")), tables.put(problem.h.select("j", "h"))
    current, previous = note(0, w, h, float("nan"), 0.0), None
    alternating = spec.method in ("als", "gnmf", "lee")
    stratified = None
    if not alternating:
        u = parse(spec.update)
        args = u.args if u.name != "Biased" else (u.args + (0.0,) * 4)[:4]
        n_entries = problem.v.count()
        if spec.method == "sgd" and n_entries > ONE_TASK:
            raise ValueError(f"{n_entries} entries are too many for one task: take dsgd")
        d = 1 if spec.method == "sgd" else spec.blocks or max(4, math.ceil((n_entries / BLOCK_ENTRIES) ** 0.5))
        regularizer, r = regularizer_of(spec.regularize), parse(spec.regularize)
        inside = spec.method not in ("asgd", "psgd") and regularizer.per_stratum
        cells = max(1, kernels.cache_blocks(problem.meta.size1, problem.meta.size2, n_entries, rank, spec.cache_kb) // d) if spec.method == "csgd" else 1
        rule = sgd.Rule(u.name, args, spec.order, spec.abs_, spec.truncate, spec.max_norm, (r.name, r.args) if inside else ("None", ()), cells)
        if spec.method != "psgd":
            stratified = sgd.Stratified(problem, rule, d, 2 * d if spec.method == "overlapped" else d, tables)
        trials = Trials(problem, rule, spec)
        policy = D.parse_decay(spec.decay, trial=trials)
    for epoch in range(1, spec.epochs + 1):
        t, eps = time.time(), float("nan")
        if alternating:
            s = parse(spec.loss)
            side = ("w" if epoch % 2 else "h") if spec.method != "gnmf" else ("h" if epoch % 2 else "w")
            if spec.method == "als":
                fixed, old = (h, w) if side == "w" else (w, h)
                new = als.half_step(problem.v, fixed, old, rank, side=side, lam=s.args[0] if s.args else 0.0, weighted=s.name == "Nzsl_Nzl2")
            else:
                new = (multiplicative.gnmf_step if spec.method == "gnmf" else multiplicative.kl_step)(problem.v, w, h, rank, side)
            w, h = (tables.put(new), h) if side == "w" else (w, tables.put(new))
        else:
            trials.factors = w, h
            eps = policy.next(epoch - 1, previous, current)
            if spec.method == "psgd":
                w, h = parallel.epoch(problem, w, h, rule, eps, spec.seed, epoch, d, spec.batches, tables)
            elif spec.method == "asgd":
                sgd.asynchronous_round(stratified, eps, (spec.seed, epoch), spec.average, None if spec.staleness < 0 else spec.staleness)
            else:
                stratified.epoch(epoch, eps, spec.seed, spec.strata, spec.group)
            if stratified:
                w, h = stratified.w(), stratified.h()
            if regularizer.name != "None" and not inside:
                w, h = (tables.put(x) for x in regularizer.apply(problem.v, w, h, rank, eps))
                if stratified:
                    stratified.set_factors(w, h)
        if spec.balance.upper() != "NONE":
            w, h = (tables.put(x) for x in balanced(problem.v, w, h, rank, spec.balance, spec.balance_method))
            if stratified:
                stratified.set_factors(w, h)
        took = time.time() - t
        previous, current = current, note(epoch, w, h, eps, took)
    trace = spark.createDataFrame(rows, "it long, epoch long, loss double, loss_test double, eps double, t_elapsed double, t_epoch double, t_loss double, t_loss_test double")
    return Result(w, h, trace)


class Trials:
    """Losses after one epoch on a sample, for each of a list of step sizes.

    The sample is a random submatrix: all entries in rows and columns drawn at one rate, so that
    there are about ``most`` entries and at most about ``most_rows`` rows and columns, with the factors of
    those rows and columns as they are when a search begins.  It goes to the driver and from there
    to one task a step size; each runs the spec's update and regularizer once and its loss.
    """

    def __init__(self, problem: Problem, rule: sgd.Rule, spec: Spec, most: int = 50_000, most_rows: int = 20_000):
        self.problem, self.rule, self.spec, self.most, self.most_rows, self.factors, self.entries = problem, rule, spec, most, most_rows, (problem.w, problem.h), None

    def _drawn(self, index: str, rate: float):
        return draws.uniform(self.spec.seed, F.lit(index), F.col(index)) < rate

    def _sample(self) -> tuple[np.ndarray, ...]:
        meta, total = self.problem.meta, max(1, self.problem.v.count())
        rate = min(1.0, (self.most / total) ** 0.5, self.most_rows / max(meta.size1, meta.size2))
        while True:
            v = self.problem.v.filter(self._drawn("i", rate) & self._drawn("j", rate))
            n = v.count()
            if n <= 2 * self.most:
                return rate, v.orderBy("i", "j").toPandas()
            rate *= (self.most / n) ** 0.5

    def __call__(self, ladder: list[float]) -> list[float]:
        spark, rule, spec = self.problem.v.sparkSession, self.rule, self.spec
        if self.entries is None:
            self.entries = self._sample()
        rate, v = self.entries
        w, h = (f.filter(self._drawn(c, rate)).orderBy(c).toPandas() for f, c in zip(self.factors, ("i", "j")))
        i, j, x = np.searchsorted(w.i.to_numpy(), v.i.to_numpy()), np.searchsorted(h.j.to_numpy(), v.j.to_numpy()), v.x.to_numpy(float)
        stack = lambda c: np.stack(c.to_numpy()) if len(c) else np.zeros((0, self.problem.rank))
        shared = spark.sparkContext.broadcast((i, j, x, stack(w.w), stack(h.h)))  # bounded by ``most`` and ``most_rows``

        def run(frames):
            i, j, x, w, h = shared.value
            n1, n2 = np.bincount(i, minlength=len(w)), np.bincount(j, minlength=len(h))
            for frame in frames:
                yield frame[["trial"]].assign(loss=[trial_loss(rule, spec, i, j, x, w, h, n1, n2, eps) for eps in frame.eps])

        todo = spark.createDataFrame([(k, float(e)) for k, e in enumerate(ladder)], "trial long, eps double").repartition(len(ladder))
        found = {r.trial: float("nan") if r.loss is None else r.loss for r in todo.mapInPandas(run, "trial long, loss double").collect()}
        return [found[k] for k in range(len(ladder))]


def trial_loss(rule: sgd.Rule, spec: Spec, i, j, x, w, h, n1, n2, eps: float) -> float:
    """The spec's loss after one update pass and one regularization step from ``w`` and ``h``."""
    w, h, s, r = w.copy(), h.copy(), parse(spec.loss), parse(spec.regularize)
    with np.errstate(all="ignore"):
        kernels.epoch(rule.kind, rule.args, i, j, x, w, h, eps, np.random.default_rng(spec.seed), np.maximum(n1, 1), np.maximum(n2, 1), rule.order, rule.abs_, rule.truncate, rule.max_norm)
        w, h = local.regularize(r.name, r.args, w, h, eps, n1, n2, max(n1.max(initial=0), n2.max(initial=0), 1))
        return local.loss(s.name, s.args, i, j, x, w, h, n1, n2)
