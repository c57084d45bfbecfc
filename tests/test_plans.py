import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave import catalogue, properties
from rankweave.model import MatrixMeta, Problem
from rankweave.operators import balance as B
from rankweave.operators import loss as L
from rankweave.operators import reshape as P
from rankweave.functions.specs import parse
from rankweave.operators import linear
from rankweave.plans import als, kernels, local, multiplicative, parallel, replay, sgd, store
from rankweave.plans import factorize as factorize_module
from rankweave.plans.factorize import Spec, Trials, factorize, loss_of, regularizer_of
from rankweave.plans.schedule import overlapped_schedule, stratum_schedule
from rankweave.plans.sgd import Rule, Stratified, disjoint
from rankweave.plans.store import Tables
from rankweave.sources import generate as G
from tests.conftest import SF


@pytest.mark.parametrize("most", [1 << 30, 20])
def test_waves_never_share_and_cover(most):
    rng = np.random.default_rng(1)
    cell = np.unique(np.concatenate([rng.integers(0, 40 * 50, 400), 3 * 50 + np.arange(50), np.arange(40) * 50 + 7]))
    i, j = cell // 50, cell % 50
    seen, steps = [], 0
    for p, groups in kernels.waves(i, j, rng.permutation(len(i)), most < 100, most):
        rows = np.concatenate([i[p], *(i[q][:, 0] if side == 0 else i[q].ravel() for side, q in groups)])
        cols = np.concatenate([j[p], *(j[q].ravel() if side == 0 else j[q][:, 0] for side, q in groups)])
        assert len(set(rows)) == len(rows) and len(set(cols)) == len(cols)
        assert all((i[q] == i[q][:, :1]).all() if side == 0 else (j[q] == j[q][:, :1]).all() for side, q in groups)
        seen += [p, *(q.ravel() for _, q in groups)]
        steps += 1
    assert sorted(np.concatenate(seen)) == list(range(len(i)))
    assert most > 100 or steps < 50  # a row of 50 takes no 50 steps


@pytest.mark.parametrize("order", ["SEQ", "WOR", "WR"])
@pytest.mark.parametrize("kind,args", [("Nzsl", ()), ("Nzsl_L2", (0.3,)), ("Nzsl_Nzl2", (0.1,)), ("Nzsl_L1", (0.1,)), ("Gkl", ())])
def test_heavy_rows_and_columns_are_a_serial_order(monkeypatch, kind, args, order):
    """Rows and columns solved in bursts give what single steps in the same order give."""
    monkeypatch.setattr(kernels, "HEAVY", 20)
    monkeypatch.setattr(kernels, "BURST", 7)
    rng = np.random.default_rng(3)
    cell = np.unique(np.concatenate([rng.integers(0, 40 * 300, 600), 5 * 300 + rng.integers(0, 300, 200), rng.integers(0, 40, 60) * 300 + 7]))
    i, j = cell // 300, cell % 300
    x, w, h = rng.random(len(i)), rng.random((40, 3)), rng.random((300, 3))
    n1, n2 = np.maximum(np.bincount(i, minlength=40), 1), np.maximum(np.bincount(j, minlength=300), 1)
    a, b, c, d = w.copy(), h.copy(), w.copy(), h.copy()
    kernels.epoch(kind, args, i, j, x, a, b, 0.02, np.random.default_rng(3), n1, n2, order=order)
    sequence = kernels.sequence_of(order, i, j, 40, 300, np.random.default_rng(3))
    if kind in kernels.LINEAR and order == "WOR":
        sequence = kernels._bursts(i, j, sequence, 20)[0]
    replay.steps(Rule(kind, args), 0.02, [(i[k], j[k], x[k]) for k in sequence], c, d, n1, n2)
    assert np.allclose(a, c, atol=1e-11) and np.allclose(b, d, atol=1e-11)
    assert order == "WR" or sorted(sequence) == list(range(len(i)))


def test_a_hot_row_takes_no_step_an_entry():
    rng = np.random.default_rng(1)
    cell = np.unique(np.concatenate([rng.integers(0, 20_000 * 100_000, 150_000), 3 * 100_000 + np.arange(100_000)]))
    i, j = cell // 100_000, cell % 100_000
    steps = sum(1 for _ in kernels.waves(i, j, rng.permutation(len(i)), True))
    assert steps < 2 * 100_000 / kernels.BURST


def test_sub_epochs_that_share_no_column_block():
    plan = overlapped_schedule(5, np.random.default_rng(2))
    assert disjoint(plan) == [(k, k + 2) for k in range(0, 10, 2)]
    assert disjoint(stratum_schedule("WOR", 4, np.random.default_rng(2))) == [(k, k + 1) for k in range(4)]


def test_blocks_follow_the_entries(spark, monkeypatch):
    """Without a number of blocks there are four, or more for more entries; one task takes no more than it may."""
    p, _, _ = planted(spark)
    monkeypatch.setattr(factorize_module, "ONE_TASK", 100)
    with pytest.raises(ValueError, match="too many for one task"):
        factorize(p, Spec(method="sgd", epochs=1))
    monkeypatch.setattr(factorize_module, "BLOCK_ENTRIES", 40)
    seen, plain = [], Stratified.__init__
    monkeypatch.setattr(Stratified, "__init__", lambda self, problem, rule, d, *more: seen.append(d) or plain(self, problem, rule, d, *more))
    factorize(p, Spec(decay="Const(0.01)", epochs=1))
    monkeypatch.setattr(factorize_module, "BLOCK_ENTRIES", 4000)
    factorize(p, Spec(decay="Const(0.01)", epochs=1))
    assert seen == [7, 4]


def test_parallel_descent_is_no_stratified_one(spark):
    p, _, _ = planted(spark)
    fits = {m: factorize(p, Spec(method=m, decay="Const(0.02)", epochs=2, blocks=3, truncate=(-100.0, 100.0))) for m in ("psgd", "dsgd")}
    w = {m: np.array([r.w for r in f.w.orderBy("i").collect()]) for m, f in fits.items()}
    loss = {m: [r.loss for r in f.trace.orderBy("epoch").collect()] for m, f in fits.items()}
    assert not np.allclose(w["psgd"], w["dsgd"]) and all(x[-1] < x[0] for x in loss.values())
    again = factorize(Problem(p.v.repartition(5), p.w, p.h, p.meta, 3, p.test), Spec(method="psgd", decay="Const(0.02)", epochs=2, blocks=3, truncate=(-100.0, 100.0)))
    assert np.allclose(w["psgd"], np.array([r.w for r in again.w.orderBy("i").collect()]), atol=1e-12)


@pytest.mark.parametrize("kind,args", [("Nzsl", ()), ("Nzsl_L2", (0.5,)), ("Nzsl_Nzl2", (0.5,)), ("Nzsl_L1", (0.5,)), ("Biased", (0.1, 0.2, 0.3, 0.4)), ("Sl", ()), ("Gkl", ()), ("None", ())])
def test_a_pass_is_a_serial_order(kind, args):
    """Vectorised batches give what single steps in the same order give."""
    rng = np.random.default_rng(2)
    i, j = rng.integers(0, 6, 60), rng.integers(0, 5, 60)
    cell = np.unique(i * 5 + j)
    i, j = cell // 5, cell % 5
    x, w, h = rng.random(len(i)), rng.random((6, 3)), rng.random((5, 3))
    n1, n2 = np.bincount(i, minlength=6), np.bincount(j, minlength=5)
    a, b = w.copy(), h.copy()
    kernels.epoch(kind, args, i, j, x, a, b, 0.05, np.random.default_rng(5), n1, n2)
    c, d = w.copy(), h.copy()
    for k in np.random.default_rng(5).permutation(len(x)):
        r, s = i[k : k + 1], j[k : k + 1]
        c[r], d[s] = kernels.step(kind, args, x[k : k + 1], c[r], d[s], 0.05, n1[r], n2[s])
    assert np.allclose(a, c) and np.allclose(b, d)


def planted(spark, **kw):
    return G.problem(spark, G.RandomMatrix(60, 50, 1500, 100, 3, "Normal(0,1)", "Normal(0,0.01)", **kw))


def test_recovery(spark):
    p, w, h = planted(spark)
    for spec in (Spec(method="als", loss="Nzsl_L2(0.001)", epochs=12), Spec(method="dsgd", decay="BoldDriver(0.02)", epochs=12, blocks=2)):
        got = factorize(p, spec)
        first, last = (got.trace.orderBy(c).first() for c in ("epoch", got.trace.epoch.desc()))
        assert last.loss_test < (0.05 if spec.method == "als" else 0.7) * first.loss_test


def test_strata_equal_serial_replay(spark):
    p, _, _ = planted(spark)
    v = {(r.i, r.j): r.x for r in p.v.collect()}
    run = Stratified(Problem(p.v, p.w, p.h, p.meta, 3), Rule(order="SEQ"), 2)
    run.epoch(1, 0.01, 7, "SEQ")
    got = np.array([r.w for r in run.w().orderBy("i").collect()]), np.array([r.h for r in run.h().orderBy("j").collect()])
    w, h = np.array([r.w for r in p.w.orderBy("i").collect()]), np.array([r.h for r in p.h.orderBy("j").collect()])
    for s in range(2):
        for b1 in range(2):
            for (i, j), x in sorted(v.items()):
                if i // 30 == b1 and j // 25 == (s + b1) % 2:
                    a, b = kernels.step("Nzsl", (), np.array([x]), w[i : i + 1], h[j : j + 1], 0.01)
                    w[i], h[j] = a[0], b[0]
    assert np.allclose(got[0], w) and np.allclose(got[1], h)


def test_als_keeps_rows_without_entries_and_matches_numpy(spark):
    v = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (2, 1, 3.0)], "i long, j long, x double")
    w = spark.createDataFrame([(i, [float(i), 9.0]) for i in range(3)], "i long, w array<double>")
    h = spark.createDataFrame([(0, [1.0, 0.5]), (1, [0.25, 2.0])], "j long, h array<double>")
    got = {r.i: r.w for r in als.half_step(v, h, w, 2).collect()}
    hm = np.array([[1.0, 0.5], [0.25, 2.0]])
    assert got[1] == [1.0, 9.0]
    assert np.allclose(got[0], np.linalg.lstsq(hm, [1.0, 2.0], rcond=None)[0])
    assert np.allclose(got[2], np.linalg.lstsq(hm[1:], [3.0], rcond=None)[0])  # least norm


def test_multiplicative_steps_make_empty_rows_zero(spark):
    v = spark.createDataFrame([(0, 0, 1.0), (2, 1, 3.0)], "i long, j long, x double")
    w = spark.createDataFrame([(i, [1.0, 0.5]) for i in range(3)], "i long, w array<double>")
    h = spark.createDataFrame([(j, [1.0, 0.5]) for j in range(2)], "j long, h array<double>")
    for step in (multiplicative.gnmf_step, multiplicative.kl_step):
        assert {r.i: r.w for r in step(v, w, h, 2, "w").collect()}[1] == [0.0, 0.0]


def test_balancing_keeps_the_product(spark):
    p, _, _ = planted(spark)
    before = L.squared(p.v, p.w, p.h, 3).first().loss
    for kind in ("L2", "NZL2"):
        for method in ("simple", "optimal"):
            w, h = B.balanced(p.v, p.w, p.h, 3, kind, method)
            assert abs(L.squared(p.v, w, h, 3).first().loss - before) < 1e-6 * before
    with pytest.raises(ValueError):
        B.balanced(p.v, p.w, p.h, 3, "L7")


def test_losses_agree_with_dense(spark):
    p, _, _ = planted(spark)
    w, h = np.array([r.w for r in p.w.orderBy("i").collect()]), np.array([r.h for r in p.h.orderBy("j").collect()])
    v = np.zeros((60, 50))
    for r in p.v.collect():
        v[r.i, r.j] = r.x
    assert np.isclose(L.full_squared(p.v, p.w, p.h, 3).first().loss, ((v - w @ h.T) ** 2).sum())
    assert np.isclose(L.gkl_model(p.w, p.h, 3).first().loss, (w @ h.T).sum())


def test_kl_is_infinite_where_the_product_is_zero(spark):
    v = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.0)], "i long, j long, x double")
    w = spark.createDataFrame([(0, [0.0])], "i long, w array<double>")
    h = spark.createDataFrame([(0, [1.0]), (1, [1.0])], "j long, h array<double>")
    assert L.kl(v, w, h, 1).first().loss == float("inf") and L.gkl(v, w, h, 1).first().loss == float("inf")


LOSSES = ["Nzsl", "NzRmse", "Nzsl_L2(0.3)", "Nzsl_L1(0.3)", "Nzsl_Nzl2(0.2)", "Biased", "Biased(0.1)", "Biased(0.1,0.2)", "Biased(0.1,0.2,0.3,0.4)", "Sl", "Gkl", "Kl"]


def counted(spark):
    p, _, _ = planted(spark)
    keep = Tables(spark).put
    v = keep(p.v.withColumn("x", F.abs("x") + 0.1))
    w, h = (keep(f.select(c, F.transform(x, lambda y: F.abs(y) + 0.1).alias(x))) for f, c, x in ((p.w, "i", "w"), (p.h, "j", "h")))
    return Problem(v, w, h, p.meta, 3, keep(p.test))


def arrays(p):
    rows = sorted((r.i, r.j, r.x) for r in p.v.collect())
    i, j, x = (np.array(c) for c in zip(*rows))
    w, h = np.array([r.w for r in p.w.orderBy("i").collect()]), np.array([r.h for r in p.h.orderBy("j").collect()])
    return i, j, x, w, h, np.bincount(i, minlength=60), np.bincount(j, minlength=50)


def test_local_losses_and_regularizers_are_those_of_tables(spark):
    p = counted(spark)
    i, j, x, w, h, n1, n2 = arrays(p)
    for name in LOSSES:
        s = parse(name)
        assert np.isclose(local.loss(s.name, s.args, i, j, x, w, h, n1, n2), loss_of(name, p.v, p.w, p.h, 3).first()[0]), name
    for name in ("None", "L1(0.3)", "L2(0.3)", "L2(40)", "Nzl2(0.1)", "Nzl2(4)", "Sl", "Gkl"):
        s = parse(name)
        a, b = regularizer_of(name).apply(p.v, p.w, p.h, 3, 0.02)
        c, d = local.regularize(s.name, s.args, w, h, 0.02, n1, n2, max(n1.max(), n2.max()))
        assert np.allclose([r.w for r in a.orderBy("i").collect()], c) and np.allclose([r.h for r in b.orderBy("j").collect()], d), name


@pytest.mark.parametrize("triple", [("Gkl", "Gkl", "Gkl"), ("Biased(0.1)", "None", "Biased(0.1)"), ("Nzsl", "Nzl2(0.05)", "Nzsl_Nzl2(0.05)")])
def test_step_search_runs_the_spec_from_the_factors_of_the_moment(spark, triple):
    p = counted(spark)
    spec = Spec(method="dsgd", update=triple[0], regularize=triple[1], loss=triple[2], decay="Auto(0.02,4)", order="SEQ")
    u, r, s = (parse(x) for x in triple)
    rule = Rule(u.name, u.args if u.name != "Biased" else (u.args * 4)[:4], "SEQ")
    trials, ladder = Trials(p, rule, spec), [0.02, 0.01, 1e9]
    i, j, x, w, h, n1, n2 = arrays(p)
    for scale in (1.0, 2.0):  # the factors move between two searches
        a, b = w * scale, h.copy()
        trials.factors = p.w.select("i", F.transform("w", lambda y: y * scale).alias("w")), p.h
        want = []
        for eps in ladder:
            c, d = a.copy(), b.copy()
            with np.errstate(all="ignore"):
                for k in range(len(x)):
                    nw, nh = kernels.step(rule.kind, rule.args, x[k : k + 1], c[i[k]][None], d[j[k]][None], eps)
                    c[i[k]], d[j[k]] = nw[0], nh[0]
                c, d = local.regularize(r.name, r.args, c, d, eps, n1, n2, max(n1.max(), n2.max()))
                want.append(local.loss(s.name, s.args, i, j, x, c, d, n1, n2))
        assert np.allclose(trials(ladder), want, equal_nan=True)
    few = Trials(p, rule, spec, most=200)
    rate, v = few._sample()
    assert 0 < len(v) <= 400 and rate < 1 and all(np.isfinite(few([0.001])))


@pytest.mark.parametrize("name", ["L1(0.3)", "L2(0.3)", "Nzl2(0.05)"])
def test_regularizers_inside_strata(spark, name):
    """Each block a stratum touches gets a step of 1 / d, d times an epoch."""
    p, s = counted(spark), parse(name)
    i, j, x, w, h, n1, n2 = arrays(p)
    run = Stratified(p, Rule("None", regularizer=(s.name, s.args)), 3)
    run.epoch(1, 0.02, 1, "SEQ")
    for _ in range(3):
        w, h = local.regularize(s.name, s.args, w, h, 0.02 / 3, n1, n2, max(n1.max(), n2.max()))
    assert np.allclose([r.w for r in run.w().orderBy("i").collect()], w) and np.allclose([r.h for r in run.h().orderBy("j").collect()], h)


def test_cache_squares():
    assert kernels.cache_blocks(100, 100, 10, 4, 1e9) == 1
    b = kernels.cache_blocks(100_000, 100_000, 1_000_000, 10, 256)
    assert abs(256 * 1024 * b * b - 200_000 * 10 * 8 * b - 24_000_000) < 2 * 256 * 1024 * b
    rng = np.random.default_rng(1)
    i, j = rng.integers(0, 40, 500), rng.integers(0, 40, 500)
    sequence = kernels.sequence_of("WOR", i, j, 40, 40, rng, 4)
    square = (i * 4 // 40 * 4 + j * 4 // 40)[sequence]
    assert sorted(sequence) == list(range(500)) and (np.diff(square) != 0).sum() == len(set(square)) - 1


def test_svd_start_is_the_best_product(spark):
    rng = np.random.default_rng(3)
    m = (rng.normal(size=(30, 3)) * [9, 5, 3]) @ rng.normal(size=(3, 20)) + 0.1 * rng.normal(size=(30, 20))
    m[:, 4] = 0
    v = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(30) for j in range(20) if m[i, j]], "i long, j long, x double")
    w, h = linear.svd_start(v, G.factor(spark, 20, 3, "Normal(0,1)", 2, "j", "h"), 3, Tables(spark).put)
    a, b = np.zeros((30, 3)), np.zeros((20, 3))
    for r in w.collect():
        a[r.i] = r.w
    for r in h.collect():
        b[r.j] = r.h
    u, d, vt = np.linalg.svd(m)
    assert np.allclose(a @ b.T, u[:, :3] * d[:3] @ vt[:3], atol=1e-3) and np.allclose((a**2).sum(axis=0), d[:3], rtol=1e-4)


def test_spec_validation():
    for bad in (dict(method="xx"), dict(method="als", loss="Sl"), dict(update="Sl", loss="Nzsl"), dict(method="overlapped", regularize="L2(1)", loss="Nzsl_L2(1)")):
        with pytest.raises(ValueError):
            Spec(**bad).checked()


def test_random_submatrix_and_core(spark):
    p, _, _ = planted(spark)
    s = P.random_submatrix(p.v, p.meta, 10, 8, 3)
    assert s.map1.count() == 10 and s.map2.count() == 8 and s.data.agg({"i": "max"}).first()[0] < 10
    assert [r.old for r in s.map1.orderBy("new").collect()] == sorted(r.old for r in s.map1.collect())
    with pytest.raises(ValueError):
        P.random_submatrix(p.v, p.meta, 61)


def test_generators_are_exact_and_repeatable(spark):
    m = G.RandomMatrix(40, 30, 700, chunks=5)
    a = {(r.i, r.j) for r in G.cells(spark, m, 700, 0).collect()}
    assert len(a) == 700 and max(i for i, _ in a) < 40 and max(j for _, j in a) < 30
    assert a == {(r.i, r.j) for r in G.cells(spark, m, 700, 0).collect()}
    assert G.cells(spark, m, 1200, 0).count() == 1200  # every cell
    assert G.RandomMatrix.from_json(m.to_json()) == m
    with pytest.raises(ValueError):
        m.chunk_sizes(1201, 0)
    assert G.sample_sizes(MatrixMeta(100, 50), 1000, target_nnz=10) == (10, 5)
    full = [sorted(map(tuple, df.collect())) for df in (G.problem(spark, m)[0].v, G.problem(spark, m)[0].v.repartition(8))]
    assert full[0] == full[1]
    cells = spark.createDataFrame([(i, j, 40.0 if i else -1.0) for i in range(9) for j in range(30)], "i long, j long, x double")
    counts = [sorted(map(tuple, P.poisson(cells.repartition(n), 3).collect())) for n in (1, 3, 8)]
    assert counts[0] == counts[1] == counts[2] and all(x == 0 for i, _, x in counts[0] if not i) and 38 < np.mean([x for i, _, x in counts[0] if i]) < 42
    f = G.factor(spark, 500, 4, "Uniform(2,3)", 1).collect()
    assert len(f) == 500 and all(2 <= x < 3 for r in f for x in r.w)


def test_large_blocks_are_taken_in_parts(spark, monkeypatch):
    """Blocks in parts and points in pieces give the vectors of plain loops; parts hold every entry once and no task gets a block as one row."""
    monkeypatch.setattr(sgd, "PART", 60)
    monkeypatch.setattr(parallel, "HELD", 100)
    assert {(r.name, r.far) for r in properties.strata_replay(spark, SF).collect()} == {(name, 0) for name in properties._REPLAYS}
    p = catalogue.dense_problem(spark, SF)
    n = p.v.count()
    for rule in (Rule(), Rule(order="SEQ"), Rule(cells=9)):
        run = Stratified(p, rule, 2)
        parts = [(r.b1, r.b2, r.part, np.frombuffer(r.i, np.int32) + run.rows.offsets[r.b1], np.frombuffer(r.j, np.int32) + run.cols.offsets[r.b2]) for r in run.data.collect()]
        assert len({(r[0], r[1], r[2]) for r in parts}) == len(parts) > 16 * (rule.cells == 1)
        assert len({(i, j) for r in parts for i, j in zip(r[3], r[4])}) == n == sum(len(r[3]) for r in parts)
        if rule == Rule():
            assert max(len(r[3]) for r in parts) < 2 * sgd.PART
    for spec in (Spec(method="sgd", decay="Const(0.005)", epochs=1), Spec(method="csgd", decay="Const(0.005)", epochs=1, blocks=2, cache_kb=4), Spec(method="asgd", decay="Const(0.002)", epochs=1, blocks=3, staleness=1)):
        first, last = (r.loss for r in factorize(p, spec).trace.orderBy("epoch").collect())
        assert last < first


def test_fits_leave_no_shuffle_setting(spark):
    was = spark.conf.get(store.CLEANUP, None)
    with store.clean_shuffles(spark):
        assert spark.conf.get(store.CLEANUP) == "true"
    assert spark.conf.get(store.CLEANUP, None) == was
