import math

import numpy as np
import pytest

from rankweave.functions import decay as D
from rankweave.functions.specs import Distribution, Spec, parse
from rankweave.model import Blocking, MatrixMeta, Problem
from rankweave.operators import linear
from rankweave.plans.schedule import overlapped_schedule, stratum_schedule


def test_specs():
    assert parse("Nzsl_L2( 0.5 )") == Spec("Nzsl_L2", (0.5,))
    assert parse("None") == Spec("None") and parse("Normal(1,2)").args == (1.0, 2.0)
    for bad in ("", "a b", "X(1", "X(1,)"):
        with pytest.raises(ValueError):
            parse(bad)
    d = Distribution.parse("Normal(3,0.5)")
    assert abs(d.draw(np.random.default_rng(1), 20_000).mean() - 3) < 0.02
    with pytest.raises(ValueError):
        Distribution.parse("Gamma(1,2)")


def test_decays():
    b = D.parse_decay("BoldDriver(1)")
    assert [b.next(0, None, 9), b.next(1, 9, 8), b.next(2, 8, 8), b.next(3, 8, 9)] == [1, 1.05, 1.05 * 0.5, 1.05 * 0.25]
    s = D.parse_decay("Sequential(2,0.5,1)")
    assert s.next(0, None, 0) == 2 and math.isclose(s.next(3, 0, 0), 2 * 2**0.5 / 5**0.5)
    assert D.parse_decay("Const(0.3)").next(7, 1, 2) == 0.3
    with pytest.raises(ValueError):
        D.parse_decay("Linear(1)")


def test_auto_decay():
    nan = float("nan")
    assert D.Auto.choose([4, 2, 1], [1.0, 2.0, 3.0]) == 4
    assert D.Auto.choose([4, 2, 1], [50.0, 1.0, 3.0]) == 2
    assert D.Auto.choose([4, 2, 1], [nan, 1.0, 3.0]) == 1
    assert D.Auto.choose([4, 2, 1], [nan, nan, 3.0]) is None
    assert D.Auto.choose([4, 2, 1], [nan] * 3) is None
    seen = []

    def trial(ladder):
        seen.append(ladder)
        return [nan if e > 0.3 else 10 - e for e in ladder]

    a = D.Auto(1.0, 3, trial)
    assert a.next(0, None, 5.0) == 0.125 and seen[0] == [1.0, 0.5, 0.25]
    assert a.next(1, 4.0, 5.0) == 0.0625  # the loss rose: bold driver from here
    assert a.next(2, 5.0, 4.0) == 0.0625 * 1.05


@pytest.mark.parametrize("order", ["SEQ", "RSEQ", "WOR", "COWOR"])
def test_schedules_are_latin(order):
    t = stratum_schedule(order, 6, np.random.default_rng(3), 2 if order == "COWOR" else 1)
    for line in (*t, *t.T):
        assert sorted(line) == list(range(6))


def test_groups_of_column_blocks_are_drawn():
    """In a turn a group of row blocks keeps as many column blocks as it has rows; which ones go together differs from seed to seed."""
    found = set()
    for seed in range(20):
        t = stratum_schedule("COWOR", 8, np.random.default_rng(seed), 2)
        groups = {frozenset(t[s : s + 2, g : g + 2].ravel().tolist()) for s in range(0, 8, 2) for g in range(0, 8, 2)}
        assert len(groups) == 4 and all(len(g) == 2 for g in groups)
        found.add(frozenset(groups))
    assert len(found) > 10


def test_other_schedules():
    wr = stratum_schedule("WR", 5, np.random.default_rng(1))
    assert all(sorted(row) == list(range(5)) for row in wr)
    t = overlapped_schedule(3, np.random.default_rng(2))
    assert t.shape == (6, 3) and all(sorted(c) == list(range(6)) for c in t.T)
    assert all(not set(a) & set(b) for a, b in zip(t, t[1:]))
    with pytest.raises(ValueError):
        stratum_schedule("XX", 2, np.random.default_rng(1))
    with pytest.raises(ValueError):
        stratum_schedule("COWOR", 5, np.random.default_rng(1), 2)


def test_blocking(spark):
    from pyspark.sql import functions as F

    for size, blocks in ((100, 7), (7, 7), (8, 3), (5, 1)):
        b = Blocking(size, blocks)
        got = [r[0] for r in spark.range(size).orderBy("id").select(b.block(F.col("id"))).collect()]
        want = [sum(o <= i for o in b.offsets) - 1 for i in range(size)]
        assert got == want and len(b.offsets) == blocks
    with pytest.raises(ValueError):
        Blocking(3, 4)


def test_problem_conforms(spark):
    v = spark.createDataFrame([(0, 1, 1.0)], "i long, j long, x double")
    w = spark.createDataFrame([(0, [1.0, 2.0])], "i long, w array<double>")
    h = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.0, 1.0])], "j long, h array<double>")
    Problem(v, w, h, MatrixMeta(1, 2), 2).verified()
    with pytest.raises(ValueError):
        Problem(v, w, h, MatrixMeta(1, 1), 2).verified()
    with pytest.raises(ValueError):
        Problem(v, w, h, MatrixMeta(1, 2), 3).verified()
    with pytest.raises(ValueError):
        Problem(v, w, w, MatrixMeta(1, 2), 2)


def test_linear_algebra():
    a = np.array([[1.0, -2, -2, -3], [3, -9, 0, -9], [-1, 2, 4, 7], [-3, -6, 26, 2]])
    x = np.array([1.0, -2, 3, 0.5])
    assert np.allclose(linear.lu_solve(linear.lu(a), a @ x), x) and np.allclose(linear.solve(a, a @ x), x)
    q, r = linear.qr(a)
    assert np.allclose(q @ r, a)
    assert np.allclose(linear.least_squares(np.array([[1.0, 1], [1, 1]]), np.array([2.0, 2])), [1, 1])  # least norm
    with pytest.raises(np.linalg.LinAlgError):
        linear.lu_solve(linear.lu(np.zeros((2, 2))), np.ones(2))
    s = np.stack([np.eye(3), np.diag([1.0, 0, 2]), np.zeros((3, 3))])
    assert np.allclose(linear.least_squares_many(s, np.ones((3, 3))), [[1, 1, 1], [1, 0, 0.5], [0, 0, 0]])
    w, h = linear.svd_factors(a, 4)
    assert np.allclose(w @ h, a)
