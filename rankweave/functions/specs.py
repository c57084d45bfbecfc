"""The ``Name(a,b)`` notation of updates, losses, decays and distributions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from . import draws

_SPEC = re.compile(r"\s*([A-Za-z_][A-Za-z0-9_]*)\s*(?:\(([^()]*)\))?\s*$")


@dataclass(frozen=True)
class Spec:
    name: str
    args: tuple[float, ...] = ()


def parse(text: str) -> Spec:
    """``Nzsl_L2(0.05)`` as a name and its numbers; anything else raises ValueError."""
    if not (m := _SPEC.match(text)):
        raise ValueError(f"not of the form Name(number,...): {text!r}")
    body = (m[2] or "").strip()
    return Spec(m[1], tuple(float(x) for x in body.split(",")) if body else ())


@dataclass(frozen=True)
class Distribution:
    """``Normal(mean,sd)`` or ``Uniform(a,b)``; the mean is honoured."""

    name: str
    a: float
    b: float

    @classmethod
    def parse(cls, text: str) -> Distribution:
        s = parse(text)
        if s.name.lower() not in ("normal", "uniform") or len(s.args) != 2:
            raise ValueError(f"unknown distribution {text!r}")
        return cls(s.name.lower(), *s.args)

    def column(self, seed: int, *keys):
        """A draw for each row that depends on the seed and the key columns alone."""
        return draws.normal(seed, *keys) * self.b + self.a if self.name == "normal" else draws.uniform(seed, *keys) * (self.b - self.a) + self.a

    def draw(self, rng, n):
        return rng.normal(self.a, self.b, n) if self.name == "normal" else rng.uniform(self.a, self.b, n)
