"""Every query with SQL gives the rows that DuckDB gives; the others run."""

import duckdb
import numpy as np
import pytest

from rankweave import catalogue
from rankweave.operators import analysis
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    assert len(a) == len(b)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    for c in cols:
        assert ((a[c].isna() & b[c].isna()) | (a[c] == b[c])).all(), c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    same(catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.ORACLE_SQL[name]).fetchdf())


@pytest.mark.parametrize("name", ["als_fit", "gnmf_fit", "lee_fit", "dsgd_fit", "overlapped_fit", "asgd_fit", "csgd_fit", "sgd_fit", "auto_decay_fit"])
def test_fits_descend(spark, name):
    loss = [r.loss for r in catalogue.QUERIES[name](spark, SF).orderBy("epoch").collect()]
    assert loss[-1] < loss[0]
    if name in ("als_fit", "gnmf_fit", "lee_fit"):
        assert all(b <= a * (1 + 1e-9) for a, b in zip(loss, loss[1:]))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) - {n for n in catalogue.QUERIES if n.endswith("_fit")}))
def test_others_run(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """Tables of more rows and columns than sf0.001, with values that tell their cell."""
    d = str(tmp_path_factory.mktemp("wide"))
    spark.range(45).selectExpr("id as s_suppkey").write.parquet(f"{d}/supplier.parquet")
    spark.range(700).selectExpr("id as p_partkey").write.parquet(f"{d}/part.parquet")
    spark.range(45 * 700).selectExpr("id div 700 as l_suppkey", "id % 700 as l_partkey", "cast(id + 1 as double) as l_quantity").filter("l_quantity % 3 > 0").write.parquet(f"{d}/lineitem.parquet")
    return d


def test_dense_forms_are_whole(spark, wide):
    got = {(r.i, r.j): r.x for r in catalogue.QUERIES["io_array"](spark, wide).collect()}
    assert got == {(i, j): float(i * 700 + j + 1) if (i * 700 + j + 1) % 3 else 0.0 for i in range(45) for j in range(700)}
    assert got == {(r.i, r.j): r.x for r in catalogue.QUERIES["io_array_parts"](spark, wide).collect()}
    for name, key, size, a, b in (("io_factor_rows", "i", 45, 7, 13), ("io_factor_columns", "j", 700, 5, 11)):
        got = {(r[key], r.k): r.value for r in catalogue.QUERIES[name](spark, wide).collect()}
        assert got == {(i, k): (a * i + b * k) % 16 / 16 for i in range(size) for k in range(catalogue.RANK)}


def test_splits_and_draws_cover_the_tables(spark, wide):
    got = {r.j: (r.block, r.offset) for r in catalogue.QUERIES["split_indexes"](spark, wide).collect()}
    assert got == {j: (b, o) for b, ids in enumerate([range(a, a + n) for a, n in zip((0, 117, 234, 351, 468, 584), (117, 117, 117, 117, 116, 116))]) for o, j in enumerate(ids)}
    cells = [int(r.x) - 1 for r in catalogue.QUERIES["random_submatrix"](spark, wide).collect()]
    assert any(c // 700 >= 10 for c in cells) and any(c % 700 >= 200 for c in cells)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_distances_of_vectors_by_blocks(spark, monkeypatch):
    """Groups of many blocks give every pair once, with the distances of plain loops; vectors with nulls and zero vectors are at 1 from all."""
    rng = np.random.default_rng(5)
    rows = [(k, k % 2 if k < 60 else None, rng.normal(size=3).tolist()) for k in range(70)] + [(100, 0, None), (101, 0, [1.0, None, 2.0]), (102, 1, [0.0, 0.0, 0.0]), (103, 7, [1.0, 2.0, 3.0])]
    v = spark.createDataFrame(rows, "id long, g int, v array<double>")
    plain = analysis.cosine_distances(v.filter("id % 5 = 0"), v, 3)
    monkeypatch.setattr(analysis, "BLOCK", 4)
    got = analysis.cosine_distances(v.filter("id % 5 = 0"), v, 3)
    found = {(r.a, r.b): r.distance for r in got.collect()}
    vectors = {i: np.array(x) for i, g, x in rows if x and None not in x and any(x)}
    groups = {i: g for i, g, _ in rows}
    want = {(a, b) for a in groups if a % 5 == 0 for b in groups if groups[a] is not None and groups[a] == groups[b]}
    assert set(found) == want and got.count() == len(want) == plain.count()
    for (a, b), x in found.items():
        one, two = vectors.get(a), vectors.get(b)
        assert x == 1 if one is None or two is None else abs(x - (1 - one @ two / np.sqrt((one @ one) * (two @ two)))) < 1e-12
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()
