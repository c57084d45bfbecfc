"""Step-size policies: driver-side rules, and the same rules as window queries over a trace."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .specs import parse


@dataclass
class Constant:
    eps: float

    def next(self, epoch: int, previous: float | None, current: float) -> float:
        return self.eps


@dataclass
class BoldDriver:
    """Grow after a better epoch, shrink after one that is not (ties shrink)."""

    eps: float
    shrink: float = 0.5
    grow: float = 1.05

    def next(self, epoch: int, previous: float | None, current: float) -> float:
        if previous is not None:
            self.eps *= self.shrink if previous <= current else self.grow
        return self.eps


@dataclass
class Sequential:
    """eps0 * (1 + A)**alpha / (n + 1 + A)**alpha."""

    eps0: float
    alpha: float = 1.0
    a: float = 0.0

    def next(self, epoch: int, previous: float | None, current: float) -> float:
        return self.eps0 * (1 + self.a) ** self.alpha / (epoch + 1 + self.a) ** self.alpha


@dataclass
class Auto:
    """Try step sizes on a sample, one epoch each, and take the best that is safe.

    ``trial`` maps a list of step sizes to the losses after one epoch with each (NaN: diverged);
    trials are independent, so a caller may run them as one distributed job.  After an epoch that
    made the loss larger the rule becomes that of the bold driver for good.
    """

    eps: float
    tries: int
    trial: Callable[[list[float]], list[float]]
    allow_increase: bool = False
    scale: float = 1.0
    most_rounds: int = 60
    bold: BoldDriver | None = field(default=None)

    def __post_init__(self):
        self.first = self.eps

    def next(self, epoch: int, previous: float | None, current: float) -> float:
        if self.bold is None and previous is not None and previous < current:
            self.bold = BoldDriver(self.eps)
        if self.bold is not None:
            self.eps = self.bold.next(epoch, previous, current)
            return self.eps * self.scale
        top = 2 * self.eps if self.allow_increase else min(2 * self.eps, self.first)
        ladder = [top / 2**k for k in range(self.tries)] if previous is None else [top - (top - self.eps / 2) * k / max(1, self.tries - 1) for k in range(self.tries)]
        for _ in range(self.most_rounds):
            if (found := self.choose(ladder, self.trial(ladder))) is not None:
                self.eps = found
                return self.eps * self.scale
            ladder = [x / 2 for x in ladder]
        raise ArithmeticError("every step size diverges")

    @staticmethod
    def choose(ladder: list[float], losses: list[float]) -> float | None:
        """The step of least loss if it is the largest, or its next larger one did not blow up; else the next smaller, or None when there is none."""
        good = [k for k, x in enumerate(losses) if not math.isnan(x)]
        if not good:
            return None
        best = min(good, key=lambda k: losses[k])
        if best == 0 or not math.isnan(losses[best - 1]) and losses[best - 1] < 100 * losses[best]:
            return ladder[best]
        return ladder[best + 1] if best + 1 < len(ladder) else None


def parse_decay(text: str, trial=None):
    """``Const(e)``, ``BoldDriver(e[,shrink,grow])``, ``Sequential(e[,alpha,A])`` or ``Auto(e,tries)``."""
    s = parse(text)
    kinds = {"const": Constant, "constant": Constant, "bolddriver": BoldDriver, "sequential": Sequential}
    if s.name.lower() in kinds:
        return kinds[s.name.lower()](*s.args)
    if s.name.lower() == "auto" and trial is not None:
        return Auto(s.args[0], int(s.args[1]) if len(s.args) > 1 else 7, trial)
    raise ValueError(f"unknown decay {text!r}")


def bold_driver_steps(trace: DataFrame, eps: float, shrink: float = 0.5, grow: float = 1.05) -> DataFrame:
    """(epoch, loss, eps) for a trace (epoch, loss): the step the bold driver takes after each epoch.  A trace is one row an epoch."""
    w = Window.orderBy("epoch")
    worse = F.lag("loss").over(w) <= F.col("loss")
    steps = trace.withColumn("d", F.when(worse, 1).otherwise(0)).withColumn("u", F.when(~worse, 1).otherwise(0))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return steps.select("epoch", "loss", (eps * F.pow(F.lit(shrink), F.sum("d").over(run)) * F.pow(F.lit(grow), F.sum("u").over(run))).alias("eps"))


def constant_steps(epochs: DataFrame, eps: float) -> DataFrame:
    """(epoch, eps) of the constant step."""
    return epochs.select("epoch", F.lit(float(eps)).alias("eps"))


def sequential_steps(epochs: DataFrame, eps0: float, alpha: float = 1.0, a: float = 0.0) -> DataFrame:
    """(epoch, eps) of the sequential decay."""
    return epochs.select("epoch", (F.lit(eps0) * F.pow(F.lit(1 + a), F.lit(alpha)) / F.pow(F.col("epoch") + 1 + a, F.lit(alpha))).alias("eps"))
