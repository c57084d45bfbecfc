"""Random numbers that depend on a seed and keys alone, as columns or as NumPy arrays.

A key tuple is hashed to 64 bits and the hash is the draw, so a value does not change with
partitions, plans, retries or the size of the cluster.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column) -> Column:
    """A number above 0 and below 1."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), *keys), 11) + 0.5) * 2.0**-53


def normal(seed: int, *keys: Column) -> Column:
    """Standard normal, by the transform of Box and Muller."""
    return F.sqrt(-2 * F.log(uniform(seed, *keys, F.lit(1)))) * F.cos(2 * math.pi * uniform(seed, *keys, F.lit(2)))


def uniform_array(seed: int, *keys: np.ndarray | int) -> np.ndarray:
    """The same idea on arrays of 64-bit integers (other draws than the columns')."""
    h = np.uint64(seed & (1 << 64) - 1)
    with np.errstate(over="ignore"):
        for k in keys:
            h = h ^ np.asarray(k).astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            h = (h ^ h >> np.uint64(31)) + np.uint64(0x632BE59BD9B4E019)
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def poisson_array(mean: np.ndarray, seed: int, *keys: np.ndarray) -> np.ndarray:
    """Poisson draws by inversion; a mean over 32 is the sum of equal parts."""
    mean = np.asarray(mean, float)
    parts = np.maximum(1, np.ceil(mean / 32)).astype(np.int64)
    total = np.zeros(len(mean))
    for p in range(int(parts.max(initial=0))):
        at = np.flatnonzero(parts > p)
        rate = mean[at] / parts[at]
        u, term, k = uniform_array(seed, *(x[at] for x in keys), p), np.exp(-rate), 0
        below = term.copy()
        while len(at):
            on = (u > below) & (term > 0)
            total[at[on]] += 1
            at, u, rate, term, below, k = at[on], u[on], rate[on], term[on], below[on], k + 1
            term = term * rate / k
            below = below + term
    return total
