"""Block files by description, tall QR and least squares, systems a row, cores by deltas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave import catalogue
from rankweave.model import Blocking, MatrixMeta
from rankweave.operators import analysis, linear
from rankweave.operators import reshape as P
from rankweave.plans.store import Tables
from rankweave.sources import blocked as K
from rankweave.sources import described
from rankweave.sources import generate as G
from rankweave.sources import matrix_market as M
from tests.conftest import SF

CELLS = sorted({(a % 11, (a * a + 3 * a) % 17, float(a) / 4) for a in range(60) if a % 11 != 10})
CELLS = list({(i, j): (i, j, x) for i, j, x in CELLS}.values())


def _matrix(spark):
    return spark.createDataFrame(CELLS, "i long, j long, x double"), MatrixMeta(11, 17)


def _rows(df):
    return sorted(map(tuple, df.select("i", "j", "x").collect()))


def test_block_files(spark, tmp_path):
    v, meta = _matrix(spark)
    K.write_block_files(v, meta, 4, 3, f"file://{tmp_path}/m", "b")
    names = sorted(p.name for p in (tmp_path / "m").iterdir() if p.suffix == ".mmc")
    assert names == sorted(f"b-{a}-{b}.mmc" for a in range(4) for b in range(3))  # empty blocks too
    got, size = described.open_matrix(spark, f"file://{tmp_path}/m/b.xml")
    assert _rows(got) == sorted(CELLS) and size == meta
    rows, cols = Blocking(11, 4).offsets, Blocking(17, 3).offsets
    of = lambda own, k: int(np.searchsorted(own, k, side="right")) - 1
    for blocks1, blocks2 in (([1, 3], None), (None, [0]), ([2], [1, 2]), ([], None)):
        got, _ = K.read_blocked(spark, f"file://{tmp_path}/m/b.xml", blocks1, blocks2)
        assert _rows(got) == sorted(c for c in CELLS if (blocks1 is None or of(rows, c[0]) in blocks1) and (blocks2 is None or of(cols, c[1]) in blocks2))
    text = (tmp_path / "m/b-1-2.mmc").read_text().split("\n")
    (tmp_path / "m/b-1-2.mmc").write_text("\n".join(text[:-2]))
    for crc in (tmp_path / "m").glob(".*.crc"):
        crc.unlink()
    assert _rows(K.read_blocked(spark, f"file://{tmp_path}/m/b.xml", [0], None)[0])  # others are not opened
    with pytest.raises(ValueError, match="another number of entries"):
        K.read_blocked(spark, f"file://{tmp_path}/m/b.xml")


def test_block_files_of_another_writer(spark, tmp_path):
    """Files anywhere, comments, blank lines, and an entry that looks like the size line."""
    at = tmp_path / "x"
    at.mkdir()
    head = "%%MatrixMarket matrix coordinate real general\n% made by hand\n\n"
    (at / "left.mmc").write_text(head + "2 2 2\n1 1 0.5\n2 2 2\n")
    (at / "right.mmc").write_text(head + "2 3 0\n")
    fields = {"size1": 2, "size2": 5, "blocks1": 1, "blocks2": 2, "blockOffsets1": [0], "blockOffsets2": [0, 2], "path": f"file://{at}", "filenames": ["left.mmc", f"file://{at}/right.mmc"], "format": "mmc"}
    K.write_descriptor(spark, f"file://{at}/d.xml", fields)
    assert _rows(K.read_blocked(spark, f"file://{at}/d.xml")[0]) == [(0, 0, 0.5), (1, 1, 2.0)]
    K.write_descriptor(spark, f"file://{at}/e.xml", fields | {"filenames": ["left.mmc"]})
    with pytest.raises(ValueError, match="1 x 2 blocks"):
        K.read_blocked(spark, f"file://{at}/e.xml")


@pytest.mark.parametrize("n,r,block,fan", [(1000, 4, 37, 3), (5, 4, 2, 2), (3, 4, 2, 2), (60, 1, 1, 4), (0, 3, 10, 2)])
def test_tall_qr(spark, n, r, block, fan):
    x = np.random.default_rng(n).normal(size=(n, r))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "i long, w array<double>")
    q, tri = linear.tall_qr(df, "i", "w", r, Tables(spark).put, block, fan)
    got = np.array([v.w for v in q.orderBy("i").collect()]).reshape(n, r)
    assert np.allclose(got @ tri, x) and np.allclose(tri, np.triu(tri)) and (np.diag(tri) >= 0).all()
    if n >= r:
        assert np.allclose(got.T @ got, np.eye(r)) and np.allclose(tri, linear.qr(x)[1])
    if n > 3 * r:
        y = x @ np.arange(2.0 * r).reshape(r, 2) + np.random.default_rng(1).normal(size=(n, 2))
        both = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "i long, w array<double>, y array<double>")
        assert np.allclose(linear.tall_least_squares(both, "i", "w", "y", r, 2, Tables(spark).put, block, fan), np.linalg.lstsq(x, y)[0])


def test_a_system_a_row(spark):
    rng = np.random.default_rng(2)
    m, b = rng.normal(size=(50, 3, 3)), rng.normal(size=(50, 3))
    m[7, 2] = m[7, 1] * 0  # singular
    m[8] = np.eye(3)[[2, 0, 1]]  # needs exchanges
    df = spark.createDataFrame([(i, a.ravel().tolist(), y.tolist()) for i, (a, y) in enumerate(zip(m, b))], "i long, m array<double>, b array<double>")
    for r in linear.lu_rows(df, "i", "m", 3, "b").collect():
        lu, order = linear.lu(m[r.i])
        assert np.allclose(np.array(r.lu).reshape(3, 3), lu) and list(r.order) == order.tolist()
        assert r.solution is None if r.i == 7 else np.allclose(m[r.i] @ r.solution, b[r.i])


@pytest.mark.parametrize("threshold", [0, 1, 2, 4])
def test_core_by_deltas(spark, threshold):
    rng = np.random.default_rng(threshold)
    cells = {(int(i), int(j)) for i, j in zip(rng.zipf(1.6, 400) % 60, rng.zipf(1.4, 400) % 40)}
    left = set(cells)
    while True:
        rows, cols = ([sum(1 for c in left if c[k] == x) for x in range(60)] for k in (0, 1))
        keep = {c for c in left if rows[c[0]] > threshold and cols[c[1]] > threshold}
        if keep == left:
            break
        left = keep
    v = spark.createDataFrame([(i, j, float(i * 100 + j)) for i, j in cells], "i long, j long, x double")
    read, put = [], Tables(spark).put
    got = P.core(v, threshold, lambda df, **by: read.append(1) or put(df, **by))
    back = got.data.join(got.map1.select(F.col("new").alias("i"), F.col("old").alias("a")), "i").join(got.map2.select(F.col("new").alias("j"), F.col("old").alias("b")), "j")
    assert sorted((r.a, r.b, r.x) for r in back.collect()) == sorted((i, j, float(i * 100 + j)) for i, j in left)
    assert got.map1.count() == len({i for i, _ in left}) and got.map2.count() == len({j for _, j in left})


@pytest.mark.parametrize("seed", range(3))
def test_slots_of_large_ranks(spark, seed):
    """As few slots as ever run at once, and no overlap; also with equal times and tasks that take none."""
    rng = np.random.default_rng(seed)
    rows = [(int(rng.integers(0, 2)), k, float(a), float(a + rng.integers(0, 6) * (seed > 0) + (seed == 0))) for k, a in enumerate(rng.integers(0, 60, 150))]
    t = spark.createDataFrame(rows, "rank long, task long, start double, stop double")
    got = {(r["rank"], r.task): r.slot for r in analysis.spread_slots(t, Tables(spark).put).collect()}
    assert len(got) == len(rows)
    for rank in (0, 1):
        own = [r for r in rows if r[0] == rank]
        events = sorted([(a, 1, 1) for _, _, a, b in own] + [(b, 0 if a < b else 2, -1) for _, _, a, b in own])
        assert len({got[rank, r[1]] for r in own}) == max(np.cumsum([e[2] for e in events]))
        for slot in {got[rank, r[1]] for r in own}:
            mine = sorted((a, b) for _, k, a, b in own if got[rank, k] == slot)
            assert all(b <= c for (_, b), (c, _) in zip(mine, mine[1:]))


@pytest.mark.parametrize("kind", ["lineitem", "close values", "low rank", "nothing"])
def test_leading_singular_values(spark, kind):
    """As a dense decomposition gives them, also where values lie close or vectors run out."""
    rng = np.random.default_rng(1)
    if kind == "lineitem":
        v = catalogue.matrix(spark, SF).withColumn("x", F.col("x").cast("double"))
        dense = np.zeros((11, 201))
        for r in v.collect():
            dense[r.i, r.j] = r.x
    else:
        u, t = (np.linalg.qr(rng.normal(size=(n, n)))[0] for n in (12, 30))
        values = {"close values": np.linspace(1.02, 1.0, 12), "low rank": np.array([5.0, 2.0] + [0.0] * 10), "nothing": np.zeros(12)}[kind]
        dense = u * values @ t[:12]
        v = spark.createDataFrame([(i, j, float(x)) for (i, j), x in np.ndenumerate(dense)], "i long, j long, x double")
    start = G.factor(spark, dense.shape[1], 3, "Normal(0,1)", 3, "j", "h")
    w, h, value = linear.leading_singular(v, start, 3, Tables(spark).put)
    want = np.linalg.svd(dense)[1][:3]
    want = want[want > 1e-12]
    assert len(value) == len(want) and np.allclose(value, want, rtol=1e-8)
    if len(want):
        rows = np.array([r.h for r in h.collect()])
        assert np.allclose(rows.T @ rows, np.eye(len(want)), atol=1e-9)


def test_sizes_after_many_comments(spark, tmp_path):
    (tmp_path / "m.mmc").write_text("%%MatrixMarket matrix coordinate real general\n" + "% note\n" * 30_000 + "\n2 3 1\n2 3 0.5\n")
    v, meta = M.read_matrix(spark, f"file://{tmp_path}/m.mmc")
    assert meta == MatrixMeta(2, 3) and _rows(v) == [(1, 2, 0.5)]
