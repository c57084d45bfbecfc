import numpy as np
import pytest

from rankweave.model import MatrixMeta, Projected
from rankweave.sources import blocked as K
from rankweave.sources import described
from rankweave.sources import generate as G
from rankweave.sources import matrix_market as M


@pytest.fixture
def v(spark):
    return spark.createDataFrame([(0, 0, 1.5), (0, 3, -2.0), (2, 1, 1 / 3), (4, 3, 7.0)], "i long, j long, x double")


META = MatrixMeta(5, 4)


def rows(df):
    return sorted(map(tuple, df.select("i", "j", "x").collect()))


def test_coordinate_round_trip(spark, v, tmp_path):
    M.write_matrix(v, META, f"{tmp_path}/m.mmc")
    got, meta = M.read_matrix(spark, f"{tmp_path}/m.mmc")
    assert meta == META and rows(got) == rows(v)


def test_coordinate_text_forms(spark, tmp_path):
    f = tmp_path / "a.mmc"
    f.write_text("%%MatrixMarket matrix coordinate integer symmetric\n% c\n\n3 3 3\n1 1 4\n3 3 3\n3 1 5\n")
    got, meta = M.read_matrix(spark, str(f))  # an entry may look like the size line
    assert rows(got) == [(0, 0, 4.0), (0, 2, 5.0), (2, 0, 5.0), (2, 2, 3.0)] and meta == MatrixMeta(3, 3)
    f.write_text("%%MatrixMarket matrix coordinate pattern general\n3 3 2\n1 1\n2 3\n")
    assert rows(M.read_matrix(spark, str(f))[0]) == [(0, 0, 1.0), (1, 2, 1.0)]
    f.write_text("%%MatrixMarket matrix coordinate real skew-symmetric\n3 3 1\n3 1 5\n")
    assert rows(M.read_matrix(spark, str(f))[0]) == [(0, 2, -5.0), (2, 0, 5.0)]
    for text in ("%%MatrixMarket matrix coordinate complex general\n1 1 1\n1 1 1 1\n", "%%MatrixMarket matrix coordinate pattern general\n1 1 2\n1 1\n", "hello\n", "%%MatrixMarket matrix coordinate real general\n2 2 2\n1 1 1\n", "%%MatrixMarket matrix coordinate real general\n2 2 1\n1 1 1\nx\n"):
        f.write_text(text)
        with pytest.raises(ValueError):
            M.read_matrix(spark, str(f))


def test_array_round_trip(spark, v, tmp_path):
    M.write_matrix(v, META, f"{tmp_path}/m.mma")
    got, meta = M.read_matrix(spark, f"{tmp_path}/m.mma")
    assert meta == META and [r for r in rows(got) if r[2]] == rows(v) and got.count() == 20
    w = {r.i: r.w for r in M.read_factor(spark, f"{tmp_path}/m.mma", "w").collect()}
    assert w[0] == [1.5, 0.0, 0.0, -2.0]


def test_array_in_parts_of_any_size(spark, tmp_path):
    """Parts follow each other by name, numbers as numbers, whatever their sizes and the order Spark lists them in."""
    folder = tmp_path / "p.mma"
    folder.mkdir()
    (folder / "part-2").write_text("%%MatrixMarket matrix array real general\n% c\n2 6\n0\n")
    (folder / "part-9").write_text("".join(f"{k}.5\n\n" for k in range(1, 11)))
    (folder / "part-10").write_text("11\n")
    got, meta = M.read_matrix(spark, str(folder))
    assert meta == MatrixMeta(2, 6) and rows(got) == sorted((k % 2, k // 2, k + 0.5 if 0 < k < 11 else float(k)) for k in range(12))
    (folder / "part-10").write_text("11\n12\n")
    with pytest.raises(ValueError):
        M.read_matrix(spark, str(folder))
    whole = spark.range(300).selectExpr("id % 20 as i", "id div 20 as j", "cast(id as double) as x")
    for single in (True, False):
        M.write_matrix(whole, MatrixMeta(20, 15), f"{tmp_path}/w{single}.mma", single=single)
        assert rows(M.read_matrix(spark, f"{tmp_path}/w{single}.mma")[0]) == rows(whole)


def test_indexes(spark, tmp_path):
    (tmp_path / "one.tsv").write_text("3\ta \"b\"\n5\tc d\n")
    (tmp_path / "two.tsv").write_text("3\ta\tx\n")
    assert sorted(map(tuple, M.read_index(spark, f"{tmp_path}/one.tsv").collect())) == [(3, 'a "b"'), (5, "c d")]
    assert list(map(tuple, M.read_index(spark, f"{tmp_path}/two.tsv", 2).collect())) == [(3, "a", "x")]
    (tmp_path / "m.mma").write_text("%%MatrixMarket matrix array integer general\n2 1\n4\n5\n")
    assert M.matrix_info(spark, f"{tmp_path}/m.mma") == {"rows": 2, "cols": 1, "entries": 2, "form": "array", "field": "integer", "symmetry": "general"}


def test_described_files(spark, v, tmp_path):
    at = lambda x: f"{tmp_path}/{x}"
    described.write_random(spark, G.RandomMatrix(40, 30, 200, 20, 3), at("p.rm"))
    p = described.open_problem(spark, at("p.rm")).verified()
    again = described.open_problem(spark, at("p.rm"), rows=at("p.rm"), columns=at("p.rm"))  # planted factors to start from
    assert p.v.count() == 200 and p.test.count() == 20 and sorted(p.v.collect()) == sorted(again.v.collect())
    from rankweave.operators import loss as L

    assert L.squared(again.test, again.w, again.h, 3).first().loss < 1e-9 < L.squared(p.test, p.w, p.h, 3).first().loss
    m = spark.createDataFrame([(0, 3), (1, 5), (2, 6), (3, 8), (4, 9)], "new long, old long")
    with pytest.raises(ValueError):
        K.write_projected(Projected(v, m, m.filter("new < 4")), at("p.mfp"))
    K.write_projected(Projected(v, m, m.filter("new < 4")), at("p.mfp"), meta=MatrixMeta(12, 10), original="all.mmc")
    got, meta = described.open_matrix(spark, at("p.mfp"))
    assert rows(got) == rows(v) and meta == MatrixMeta(5, 4) and K.read_descriptor(spark, at("p.mfp"))["matrixFilename"] == ["all.mmc"]
    assert sorted(map(tuple, K.read_projected(spark, at("p.mfp")).map1.collect())) == sorted(map(tuple, m.collect()))
    K.write_blocked(v, META, 2, 2, at("b"))
    assert rows(described.open_matrix(spark, at("b/description.xml"))[0]) == rows(v)
    v.write.parquet(at("v.parquet"))
    drawn = described.open_problem(spark, at("v.parquet"), rank=2).verified()
    assert drawn.rank == 2 and drawn.test is None
    with pytest.raises(ValueError):
        described.open_problem(spark, at("v.parquet"))


def test_formats(spark, v, tmp_path):
    assert M.format_of("x.mmc") == "coordinate" and M.is_sparse("coordinate") and not M.is_sparse("array")
    for bad, error in (("x.bst", NotImplementedError), ("x.foo", ValueError)):
        with pytest.raises(error):
            M.format_of(bad)
    with pytest.raises(NotImplementedError):
        M.write_matrix(v, META, f"{tmp_path}/d.mmc", dense=True)
    M.write_matrix(v, META, f"{tmp_path}/m.csv")
    M.convert(spark, f"{tmp_path}/m.csv", f"{tmp_path}/m.parquet")
    assert rows(M.read_matrix(spark, f"{tmp_path}/m.parquet")[0]) == rows(v)


def test_blocked(spark, v, tmp_path):
    K.write_blocked(v, META, 2, 2, f"{tmp_path}/b")
    got, meta = K.read_blocked(spark, f"{tmp_path}/b")
    assert meta == META and rows(got) == rows(v)
    part, _ = K.read_blocked(spark, f"{tmp_path}/b", [0], [1])
    assert rows(part) == [(0, 3, -2.0)]
    assert "PartitionFilters: [isnotnull(b1" in part._jdf.queryExecution().toString()


def test_descriptors_and_maps(spark, v, tmp_path):
    K.write_descriptor(spark, f"{tmp_path}/d.xml", {"size1": 5, "filename": ["a", "b<c"]})
    assert K.read_descriptor(spark, f"{tmp_path}/d.xml") == {"size1": ["5"], "filename": ["a", "b<c"]}
    m = spark.createDataFrame([(0, 3), (1, 5)], "new long, old long")
    K.write_map(m, 9, f"{tmp_path}/m.mfm")
    assert sorted(map(tuple, K.read_map(spark, f"{tmp_path}/m.mfm").collect())) == [(0, 3), (1, 5)]
    K.write_projected(Projected(v, m, m), f"{tmp_path}/p")
    assert rows(K.read_projected(spark, f"{tmp_path}/p").data) == rows(v)


def test_streams(spark, tmp_path):
    from rankweave.streaming import entries as E

    v = spark.createDataFrame([(i % 3, i, float(i)) for i in range(30)], "i long, j long, x double")
    v.repartition(5).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("i long, j long, x double").option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    q = E.running_totals(stream).writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = {r.i: (r.nnz, r.total) for r in spark.table("totals").collect()}
    assert got == {i: (10, float(sum(range(i, 30, 3)))) for i in range(3)}
    assert np.isclose(sum(t for _, t in got.values()), sum(range(30)))


def test_late_events_go(spark, tmp_path):
    from datetime import datetime, timedelta

    from rankweave.streaming import entries as E

    t0, schema = datetime(2024, 1, 1), "ts timestamp, event_type string, value double"
    put = lambda hours: spark.createDataFrame([(t0 + timedelta(hours=h), "a", 1.0) for h in hours], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
    put([0, 1])
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/e")
    q = E.windowed_counts(stream, "ts", "event_type", "value").writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    for hours in ([5], [0, 6], [9]):  # the second hour 0 is far behind
        q.processAllAvailable()
        put(hours)
    q.processAllAvailable()
    q.stop()
    got = {r.start.hour: r.n for r in spark.table("late").collect()}
    assert got[0] == 1 and got[1] == 1 and got[5] == 1


def test_array_text_in_ranges_of_cells(spark, tmp_path, monkeypatch):
    """Ranges of any size hold the cells in order, zeros between; nothing but the given cells is shuffled, and no line is sorted."""
    v = spark.createDataFrame([(i, j, i + j / 7 - 3) for i in range(9) for j in range(11) if (i * j) % 5 == 3] + [(0, 3, None)], "i long, j long, x double")
    want = {(i, j): 0.0 for i in range(9) for j in range(11)} | {(r.i, r.j): r.x or 0.0 for r in v.collect()}
    for cells, lines, ends in ((7, 3, ()), (1000, 100_000, ()), (1000, 5, (0.01, 0.01, 0.4, 1.0))):
        monkeypatch.setattr(M, "PART_CELLS", cells)
        monkeypatch.setattr(M, "LINES", lines)
        path = f"{tmp_path}/{cells}-{lines}.mma"
        M.write_array(v, MatrixMeta(9, 11), path, ends=ends)
        got = M.read_matrix(spark, path)[0]
        assert {(r.i, r.j): r.x for r in got.collect()} == want and got.count() == 99
        assert not any(x in got._jdf.queryExecution().executedPlan().toString() for x in ("Window", "Sort"))
    with pytest.raises(Exception, match="there twice"):
        M.write_array(v.union(v), MatrixMeta(9, 11), f"{tmp_path}/twice.mma")
