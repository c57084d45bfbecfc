"""Queries on what has no rows of its own to compare: formats, draws, schedules, orders, fits, tools.

Each gives facts that hold for every right implementation, and SQL gives the same facts from the
tables or as constants.  Floating facts are rounded or compared with a bound.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import catalogue as C
from .__main__ import main
from .catalogue import N1, RANK, V, _OP, _path, _sections, column_factor, matrix, query, row_factor, rounded, sizes, table, wl
from .functions import decay as D
from .functions.specs import Distribution, parse
from .functions.vectors import dot, each, long
from .model import Blocking, MatrixMeta, Problem
from .operators import analysis as N
from .operators import linear
from .operators import reshape as P
from .plans import kernels, parallel, replay, sgd
from .plans.factorize import Spec, factorize
from .plans.schedule import schedule_table
from .plans.store import Tables
from .session import ship
from .sources import blocked as K
from .sources import described
from .sources import generate as G
from .sources import matrix_market as M


def facts(s, **found) -> DataFrame:
    """(fact, value), one row a keyword; whole numbers."""
    return s.createDataFrame([(k, int(v)) for k, v in found.items()], "fact string, value long")


def facts_sql(**wanted) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', CAST({v} AS BIGINT))" for k, v in wanted.items()) + ") t(fact, value)"


def refused(f, *args, **kw) -> str:
    try:
        f(*args, **kw)
    except Exception as e:  # noqa: BLE001  the kind of error is the result
        return type(e).__name__
    return "none"


# --- formats and files ----------------------------------------------------------------------------


_KINDS = "['mmc', 'mma', 'parquet', 'csv', 'mfp', 'mfm', 'rm', 'xml']", "['coordinate', 'array', 'parquet', 'csv', 'projected', 'map', 'random', 'blocked']"


@query("formats", f"SELECT n_name || '.' || ({_KINDS[0]})[1 + n_nationkey % 8] AS name, ({_KINDS[1]})[1 + n_nationkey % 8] AS fmt, n_nationkey % 8 NOT IN (1, 5) AS sparse FROM nation")
def formats(s, d):
    """The format and form of files named after the nations."""
    names = [f"{r.n_name}.{list(M.FORMATS)[r.n_nationkey % len(M.FORMATS)]}" for r in table(s, d, "nation").collect()]
    return s.createDataFrame([(n, M.format_of(f"/a.b/{n}"), M.is_sparse(M.format_of(n))) for n in names], "name string, fmt string, sparse boolean")


@query("refusals", "SELECT * FROM (VALUES ('platform archive', 'NotImplementedError'), ('unknown file', 'ValueError'), ('dense as coordinate', 'NotImplementedError'), ('unknown loss for als', 'ValueError'), ('update that does not fit', 'ValueError'), ('regularizer with overlapped strata', 'ValueError'), ('unknown decay', 'ValueError'), ('unknown distribution', 'ValueError'), ('more cells than there are', 'ValueError'), ('more blocks than rows', 'ValueError')) t(what, error)")
def refusals(s, d):
    tries = {
        "platform archive": (M.format_of, "m.bsb"), "unknown file": (M.format_of, "m.foo"), "unknown decay": (D.parse_decay, "Linear(1)"), "unknown distribution": (Distribution.parse, "Gamma(1,2)"),
        "dense as coordinate": (lambda: M.write_matrix(matrix(s, d), sizes(s, d), "m.mmc", dense=True),), "unknown loss for als": (Spec(method="als", loss="Sl").checked,),
        "update that does not fit": (Spec(update="Sl", loss="Nzsl").checked,), "regularizer with overlapped strata": (Spec(method="overlapped", regularize="L2(1)", loss="Nzsl_L2(1)").checked,),
        "more cells than there are": (lambda: G.RandomMatrix(3, 3, 10).chunk_sizes(10, 0),), "more blocks than rows": (Blocking, 3, 4),
    }
    return s.createDataFrame([(k, refused(*f)) for k, f in tries.items()], "what string, error string")


@query("io_descriptor", f"WITH {V} SELECT i, j, x FROM v")
def io_descriptor(s, d):
    """A blocked matrix read by its XML description."""
    path = _path(s, "described")
    K.write_blocked(matrix(s, d), sizes(s, d), 5, 7, path)
    return described.open_matrix(s, f"{path}/description.xml")[0]


_B57 = f"WITH {V}, z AS (SELECT max(i) + 1 AS r, max(j) + 1 AS c FROM v), o AS (SELECT i, j, x, (SELECT count(*) - 1 FROM range(5) t(b) WHERE b * (r // 5) + least(b, r % 5) <= i) AS b1, (SELECT count(*) - 1 FROM range(7) t(b) WHERE b * (c // 7) + least(b, c % 7) <= j) AS b2 FROM v, z)"


def _block_files(s, d) -> str:
    path = _path(s, "files")
    K.write_block_files(matrix(s, d), sizes(s, d), 5, 7, path, "m")
    return f"{path}/m.xml"


query("io_block_files", f"WITH {V} SELECT i, j, x FROM v")(lambda s, d: described.open_matrix(s, _block_files(s, d))[0])  # 35 text files and their description
query("io_some_block_files", f"{_B57} SELECT i, j, x FROM o WHERE b1 IN (1, 4) AND b2 IN (0, 2, 6)")(lambda s, d: K.read_blocked(s, _block_files(s, d), [1, 4], [0, 2, 6])[0])


@query("io_some_blocks", f"{_B57} SELECT i, j, x FROM o WHERE (b1, b2) IN ((0, 0), (3, 5))")
def io_some_blocks(s, d):
    """Two blocks of one text file."""
    path = _path(s, "m.mmc")
    M.write_matrix(matrix(s, d), sizes(s, d), path)
    return K.read_some_blocks(s, path, 5, 7, [(0, 0), (3, 5)])[0]


@query("io_projection_file", f"WITH {_OP}, {C._FREQ.format(t=4)} SELECT r.new AS i, c.new AS j, x, r.old AS row, c.old AS col FROM v JOIN r ON r.old = v.i JOIN c ON c.old = v.j")
def io_projection_file(s, d):
    """A projection as a description, a matrix and two index maps, read again with both maps."""
    path = _path(s, "orders.mfp")
    top = table(s, d, "lineitem").agg(F.max("l_orderkey"), F.max("l_partkey")).first()
    K.write_projected(P.frequent(C.order_matrix(s, d), 4), path, meta=MatrixMeta(top[0] + 1, top[1] + 1), original="orders.mmc")
    p = K.read_projected(s, path)
    one, two = (m.select(F.col("new").alias(c), F.col("old").alias(n)) for m, c, n in ((p.map1, "i", "row"), (p.map2, "j", "col")))
    return p.data.join(one, "i").join(two, "j").select("i", "j", "x", "row", "col")


_SYM = "u AS (SELECT l_suppkey AS i, l_suppkey % 7 AS j, sum(l_quantity) AS x FROM lineitem GROUP BY 1, 2), t AS (SELECT greatest(i, j) AS i, least(i, j) AS j, sum(x) AS x FROM u GROUP BY 1, 2)"


def _symmetric(s, d, kind: str) -> DataFrame:
    """A lower triangle of suppliers, written as text with the banner of a kind and read again."""
    path, size = _path(s, "m.mmc"), sizes(s, d).size1
    u = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("i"), (F.col("l_suppkey") % 7).alias("j")).agg(F.sum("l_quantity").alias("x"))
    t = u.groupBy(F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j")).agg(F.sum("x").alias("x"))
    t = t.filter("i <> j") if "skew" in kind else t
    form = F.format_string("%d %d", F.col("i") + 1, F.col("j") + 1) if kind.startswith("pattern") else F.format_string("%d %d %.1f", F.col("i") + 1, F.col("j") + 1, F.col("x"))
    head = s.createDataFrame([(-2, 0, f"%%MatrixMarket matrix coordinate {kind}"), (-1, 0, f"{size} {size} {t.count()}")], "i long, j long, value string")
    head.union(t.select("i", "j", form)).orderBy("i", "j").select("value").write.text(path)
    return M.read_matrix(s, path)[0]


query("io_symmetric", f"WITH {_SYM} SELECT i, j, x FROM t UNION ALL SELECT j, i, x FROM t WHERE i <> j")(lambda s, d: _symmetric(s, d, "real symmetric"))
query("io_skew_symmetric", f"WITH {_SYM} SELECT i, j, x FROM t WHERE i <> j UNION ALL SELECT j, i, -x FROM t WHERE i <> j")(lambda s, d: _symmetric(s, d, "real skew-symmetric"))
query("io_pattern", f"WITH {_SYM} SELECT i, j, CAST(1 AS DOUBLE) AS x FROM t UNION ALL SELECT j, i, 1 FROM t WHERE i <> j")(lambda s, d: _symmetric(s, d, "pattern symmetric"))


@query("io_info", f"WITH {V} SELECT 100000 AS rows, 90000 AS cols, count(*) AS entries, 'coordinate' AS form, 'real' AS field, 'general' AS symmetry FROM v")
def io_info(s, d):
    path = _path(s, "m.mmc")
    M.write_matrix(matrix(s, d), MatrixMeta(100_000, 90_000), path)
    return s.createDataFrame([tuple(M.matrix_info(s, path).values())], "rows int, cols int, entries long, form string, field string, symmetry string")


@query("io_index", "SELECT p_partkey AS key, p_name AS value FROM part")
def io_index(s, d):
    path = _path(s, "index")
    table(s, d, "part").select(F.concat_ws("\t", "p_partkey", "p_name").alias("value")).write.text(path)
    return M.read_index(s, path)


@query("io_index_pair", "SELECT p_partkey AS key, p_name AS value1, p_brand AS value2 FROM part")
def io_index_pair(s, d):
    path = _path(s, "index")
    table(s, d, "part").select(F.concat_ws("\t", "p_partkey", "p_name", "p_brand").alias("value")).write.text(path)
    return M.read_index(s, path, 2)


# --- generators -----------------------------------------------------------------------------------


_SIZES = "(SELECT count(*) FROM v) AS n, (SELECT max(i) + 1 FROM v) AS r, (SELECT max(j) + 1 FROM v) AS c"


def _like_matrix(s, d, **more):
    """A random problem with the sizes and the number of entries of the matrix."""
    return G.RandomMatrix(sizes(s, d).size1, sizes(s, d).size2, matrix(s, d).count(), **more)


def _sized(**wanted) -> str:
    return f"WITH {V}, z AS (SELECT {_SIZES}), f AS (SELECT unnest([" + ", ".join(f"{{'fact': '{k}', 'value': CAST({v} AS BIGINT)}}" for k, v in wanted.items()) + "]) AS f FROM z) SELECT f.fact AS fact, f.value AS value FROM f"


@query("described_problem", _sized(train="n", test="n // 10", rows="r", columns="c", rank=5, unequal=0))
def described_problem(s, d):
    """A .rm file with the sizes of the matrix, opened twice, gives one problem."""
    path, m = _path(s, "p.rm"), _like_matrix(s, d)
    described.write_random(s, G.RandomMatrix(m.size1, m.size2, m.nnz, m.nnz // 10, 5), path)
    one, two = (described.open_problem(s, path) for _ in range(2))
    unequal = one.v.exceptAll(two.v.repartition(3)).count() + one.w.exceptAll(two.w).count() + one.test.exceptAll(two.test).count()
    return facts(s, train=one.v.count(), test=one.test.count(), rows=one.meta.size1, columns=one.meta.size2, rank=one.rank, unequal=unequal)


@query("problem_from_files", f"WITH {V}, f(fact, value) AS (SELECT 'entries', count(*) FROM v UNION ALL SELECT 'rows', max(i) + 1 FROM v UNION ALL SELECT 'columns', max(j) + 1 FROM v UNION ALL SELECT 'rank', 3 UNION ALL SELECT 'row_factors', max(i) + 1 FROM v) SELECT fact, CAST(value AS BIGINT) AS value FROM f")
def problem_from_files(s, d):
    path = _path(s, "m.parquet")
    matrix(s, d).write.parquet(path)
    p = described.open_problem(s, path, rank=3).verified()
    return facts(s, entries=p.v.count(), rows=p.meta.size1, columns=p.meta.size2, rank=p.rank, row_factors=p.w.count())


@query("draws_by_cell", _sized(entries="n", changed="n", unequal_values=0, vectors="(SELECT count(*) FROM supplier)", unequal_factors=0, unequal_permutations=0, unequal_counts=0))
def draws_by_cell(s, d):
    """Noise on the matrix, counts with its values as means, and vectors of its rows do not depend on partitions; noise changes every value."""
    v, w = Tables(s).put(matrix(s, d).withColumn("x", F.col("x").cast("double"))), table(s, d, "supplier").select(F.col("s_suppkey").alias("id"))
    noisy = lambda df: P.noisy(df, Distribution.parse("Normal(0,1)"), 4)
    many = lambda df: df.repartition(7)
    counts = lambda df: P.poisson(df, 3)
    perm = [P.permutation(sizes(s, d).size2, s, 2) for _ in range(2)]
    draw = lambda ids: ids.select("id", each(4, lambda k: Distribution.parse("Uniform(2,3)").column(9, F.col("id"), F.lit(k))).alias("w"))
    return facts(
        s, entries=noisy(v).count(), changed=noisy(v).join(v.withColumnRenamed("x", "y"), ["i", "j"]).filter("x <> y").count(), unequal_values=noisy(v).exceptAll(noisy(many(v))).count(),
        vectors=draw(w).count(), unequal_factors=draw(w).exceptAll(draw(many(w))).count(), unequal_permutations=perm[0].exceptAll(perm[1]).count(), unequal_counts=counts(v).exceptAll(counts(many(v))).count(),
    )


@query("distributions", f"WITH {V} SELECT spec, (SELECT count(*) FROM v) AS n, TRUE AS mean_fits, TRUE AS deviation_fits, TRUE AS inside FROM (VALUES ('Normal(3,0.5)'), ('Uniform(2,5)')) t(spec)")
def distributions(s, d):
    """A draw for each cell of the matrix: mean and deviation within six standard errors, Uniform inside its bounds."""
    out, cells = None, matrix(s, d)
    for spec, mean, sd in (("Normal(3,0.5)", 3.0, 0.5), ("Uniform(2,5)", 3.5, 3 / 12**0.5)):
        x = cells.select(Distribution.parse(spec).column(11, F.col("i"), F.col("j")).alias("x"))
        inside = (F.min("x") > 2) & (F.max("x") < 5) if spec.startswith("U") else F.lit(True)
        near = lambda c, y, scale: F.abs(c - y) < 6 * scale / F.sqrt(F.count("*"))
        row = x.agg(F.lit(spec).alias("spec"), F.count("*").alias("n"), near(F.avg("x"), mean, sd).alias("mean_fits"), near(F.stddev("x"), sd, sd).alias("deviation_fits"), inside.alias("inside"))
        out = row if out is None else out.union(row)
    return out


@query("poisson_counts", f"WITH {V} SELECT CAST(x AS BIGINT) % 5 AS part, count(*) AS n, TRUE AS mean_fits, TRUE AS whole FROM v GROUP BY 1")
def poisson_counts(s, d):
    """Counts with the values of the matrix as means: their sum is within six standard errors of the sum of the means."""
    v = matrix(s, d).select("i", "j", F.col("x").cast("double").alias("x"))
    both = P.poisson(v, 5).withColumnRenamed("x", "k").join(v, ["i", "j"])
    return both.groupBy((F.col("x").cast("long") % 5).alias("part")).agg(F.count("*").alias("n"), (F.abs(F.sum("k") - F.sum("x")) < 6 * F.sqrt(F.sum("x"))).alias("mean_fits"), F.every((F.col("k") == F.floor("k")) & (F.col("k") >= 0)).alias("whole"))


@query("shuffle_keeps_rows", f"WITH {wl()} SELECT i, CAST(k AS INTEGER) AS k, w AS value FROM wl")
def shuffle_keeps_rows(s, d):
    """Row vectors under a permutation of their indexes, and back."""
    perm = P.permutation(sizes(s, d).size1, s, 2)
    back = P.permuted(row_factor(s, d), "i", perm).join(perm.select(F.col("new").alias("i"), "old"), "i").select(F.col("old").alias("i"), "w")
    return long(back, "i", "w")


@query("random_submatrix_facts", f"WITH {V} " + facts_sql(rows=5, columns=100, strange_entries=0, out_of_order=0))
def random_submatrix_facts(s, d):
    """Rows and columns drawn without replacement, in order, with the entries of the matrix."""
    v = matrix(s, d)
    p = P.random_submatrix(v, sizes(s, d), 5, 100)
    back = p.data.join(p.map1.select(F.col("new").alias("i"), F.col("old").alias("oi")), "i").join(p.map2.select(F.col("new").alias("j"), F.col("old").alias("oj")), "j").select(F.col("oi").alias("i"), F.col("oj").alias("j"), "x")
    inside = v.join(p.map1.select(F.col("old").alias("i")), "i").join(p.map2.select(F.col("old").alias("j")), "j").select("i", "j", "x")
    strange = back.exceptAll(inside).count() + inside.exceptAll(back).count()
    order = lambda m: m.alias("a").join(m.alias("b"), F.expr("a.new + 1 = b.new and a.old >= b.old")).count()
    return facts(s, rows=p.map1.select("old").distinct().count(), columns=p.map2.select("old").distinct().count(), strange_entries=strange, out_of_order=order(p.map1) + order(p.map2))


# --- schedules, orders, decays ----------------------------------------------------------------------

_ORDERS = {"SEQ": 1, "RSEQ": 1, "WOR": 1, "COWOR": 3, "OVERLAPPED": 1}


def _block_counts(s, d, d1: int, d2: int) -> DataFrame:
    """(b1, b2, n): entries of the blocks of the matrix, by remainders of its indexes."""
    return matrix(s, d).groupBy((F.col("i") % d1).cast("long").alias("b1"), (F.col("j") % d2).cast("long").alias("b2")).agg(F.count("*").alias("n"))


@query("schedule_facts", f"WITH {V}, b AS (SELECT i % 6 AS b1, count(*) AS entries FROM v GROUP BY 1) SELECT name, b1, entries, CASE name WHEN 'OVERLAPPED' THEN 12 ELSE 6 END AS turns, CAST(6 AS BIGINT) AS least FROM b, (SELECT unnest({list(_ORDERS)}) AS name)")
def schedule_facts(s, d):
    """Entries that each row block meets in an epoch, all of its own once; sub-epochs; column blocks at work in each at least."""
    out = None
    for name, group in _ORDERS.items():
        t = schedule_table(s, name, 6, 3, group)
        met = t.join(_block_counts(s, d, 6, 12 if name == "OVERLAPPED" else 6), ["b1", "b2"], "left").groupBy("b1").agg(F.sum("n").alias("entries"))
        least = t.groupBy("sub_epoch").agg(F.countDistinct("b2").alias("k")).agg(F.min("k").alias("least"), F.count("*").cast("int").alias("turns"))
        row = met.crossJoin(least).select(F.lit(name).alias("name"), "b1", "entries", "turns", "least")  # one row
        out = row if out is None else out.union(row)
    return out


@query("schedule_with_replacement", f"WITH {V} SELECT i % 6 AS b1, CAST(6 AS BIGINT) AS meetings, TRUE AS possible FROM v GROUP BY 1")
def schedule_with_replacement(s, d):
    """Each row block meets six column blocks; those that come again count again."""
    t = schedule_table(s, "WR", 6, 3).join(_block_counts(s, d, 6, 6), ["b1", "b2"], "left")
    top = _block_counts(s, d, 6, 6).groupBy("b1").agg(F.max("n").alias("top"))
    return t.groupBy("b1").agg(F.count("*").alias("meetings"), F.sum("n").alias("entries")).join(top, "b1").select("b1", "meetings", (F.col("entries") <= 6 * F.col("top")).alias("possible"))


@query("schedule_overlap", f"WITH {V} SELECT i % 7 AS b1, count(*) AS entries, CAST(0 AS BIGINT) AS shared FROM v GROUP BY 1")
def schedule_overlap(s, d):
    """Entries that each row block meets under the overlapped schedule, and those in column blocks that the sub-epoch before also has."""
    t, n = schedule_table(s, "OVERLAPPED", 7, 5), _block_counts(s, d, 7, 14)
    before = t.select((F.col("sub_epoch") + 1).alias("sub_epoch"), "b2", F.lit(True).alias("again"))
    met = t.join(before, ["sub_epoch", "b2"], "left").join(n, ["b1", "b2"])
    return met.groupBy("b1").agg(F.sum("n").alias("entries"), F.sum(F.when(F.col("again"), F.col("n")).otherwise(0)).alias("shared"))


@query("schedule_groups", f"WITH {V} SELECT seed, i % 8 // 2 AS g1, count(*) AS entries, CAST(2 AS BIGINT) AS most, CAST(8 AS BIGINT) AS met FROM v, (SELECT unnest([1, 2, 3]) AS seed) GROUP BY 1, 2")
def schedule_groups(s, d):
    """Under random groups of two: entries that a pair of row blocks meets, column blocks that it has in a turn at most, and in all turns."""
    n, out = _block_counts(s, d, 8, 8), None
    for seed in (1, 2, 3):
        t = schedule_table(s, "COWOR", 8, seed, 2).withColumns({"turn": F.floor(F.col("sub_epoch") / 2), "g1": F.floor(F.col("b1") / 2)})
        most = t.groupBy("g1", "turn").agg(F.countDistinct("b2").alias("k")).groupBy("g1").agg(F.max("k").alias("most"))
        row = t.join(n, ["b1", "b2"], "left").groupBy("g1").agg(F.sum("n").alias("entries"), F.countDistinct("b2").alias("met")).join(most, "g1").select(F.lit(seed).alias("seed"), "g1", "entries", "most", "met")
        out = row if out is None else out.union(row)
    return out


query("constant_decay", f"WITH {C._T} SELECT epoch, CAST(0.01 AS DOUBLE) AS eps FROM t")(lambda s, d: D.constant_steps(C._trace(s, d), D.parse_decay("Const(0.01)").next(0, None, 1.0)))


@query("decay_names", "SELECT n_name AS name, ['Constant', 'BoldDriver', 'Sequential'][1 + n_nationkey % 3] AS kind, (n_nationkey + 1) / 10 AS first FROM nation")
def decay_names(s, d):
    """Policies named by a specification with a nation's number in it, and their first steps."""
    spec = lambda k: f"{('Const', 'BoldDriver', 'Sequential')[k % 3]}({(k + 1) / 10}{',0.5,1' if k % 3 == 2 else ''})"
    return s.createDataFrame([(r.n_name, type(p := D.parse_decay(spec(r.n_nationkey))).__name__, p.next(0, None, 1.0)) for r in table(s, d, "nation").collect()], "name string, kind string, first double")


@query("step_search", f"""WITH {V}, {wl(plus=1)}, {C.hl(plus=1)}, {C.e_()}, t AS (SELECT 1 / pow(2, k) AS eps FROM range(6) r(k)),
    l AS (SELECT eps, sum((x / 25 - dot * (1 - eps)) ** 2) AS loss FROM e, t GROUP BY 1) SELECT eps, round(loss, 4) AS loss FROM l ORDER BY l.loss LIMIT 1""")
def step_search(s, d):
    """The best of six step sizes, each tried on the whole matrix: how much the product of the factors is to shrink."""
    p = C.dense_problem(s, d)
    e = Tables(s).put(p.v.join(p.w, "i").join(p.h, "j").select("x", dot("w", "h", RANK).alias("dot")))
    tried = {}

    def trial(ladder):
        row = e.agg(*(F.sum((F.col("x") - F.col("dot") * (1 - k)) ** 2) for k in ladder)).head()
        tried.update(zip(ladder, row))
        return list(row)

    eps = D.Auto(1.0, 6, trial).next(0, None, 0.0)
    return rounded(s.createDataFrame([(eps, tried[eps])], "eps double, loss double"), "loss", digits=4)


@query("spec_grammar", "SELECT n_name AS name, CAST(n_nationkey % 4 AS INTEGER) AS n, CAST(n_nationkey * (n_nationkey % 4) AS DOUBLE) AS total FROM nation")
def spec_grammar(s, d):
    """Specifications named after the nations, with as many arguments as a remainder says."""
    found = [(r.n_name, r.n_nationkey, parse(f" {r.n_name.replace(' ', '_')}( {' , '.join([str(r.n_nationkey)] * (r.n_nationkey % 4))} ) " if r.n_nationkey % 4 else r.n_name.replace(" ", "_"))) for r in table(s, d, "nation").collect()]
    return s.createDataFrame([(name if p.name == name.replace(" ", "_") else p.name, len(p.args), float(sum(p.args))) for name, _, p in found], "name string, n int, total double")


@query("valid_specs", "SELECT CAST(10 AS BIGINT) AS n")
def valid_specs(s, d):
    """How many of all combinations of update, regularizer and loss are accepted."""
    names = ("None", "Nzsl", "Nzsl_L1", "Nzsl_L2", "Nzsl_Nzl2", "Biased", "Sl", "Gkl", "L1", "L2", "Nzl2")
    n = sum(refused(Spec(update=u, regularize=r, loss=x).checked) == "none" for u in names for r in names for x in names)
    return s.createDataFrame([(n,)], "n long")


@query("orders_of_entries", f"""WITH {V}, b AS (SELECT i % 8 AS b1, count(*) AS visits, sum(x) AS total FROM v GROUP BY 1), n AS (SELECT unnest(['SEQ', 'WOR', 'WOR in bursts', 'WOR in squares']) AS name)
    SELECT name, b1, visits, visits AS entries, total, CAST(0 AS BIGINT) AS clashes FROM b, n""")
def orders_of_entries(s, d):
    """Each order of a pass over the blocks of the matrix visits every entry once, and in no step two of one row or column."""
    ship(s)
    names = {"SEQ": ("SEQ", 1, 1 << 30), "WOR": ("WOR", 1, 1 << 30), "WOR in bursts": ("WOR", 1, 20), "WOR in squares": ("WOR", 4, 1 << 30)}

    def f(key, own):
        i, j, x = (own.column(c).to_numpy() for c in ("i", "j", "x"))
        i, j = (np.unique(c, return_inverse=True)[1] for c in (i, j))
        rows = []
        for name, (order, cells, heavy) in names.items():
            sequence = kernels.sequence_of(order, i, j, int(i.max()) + 1, int(j.max()) + 1, np.random.default_rng(key[0].as_py()), cells)
            seen, clashes = [], 0
            for p, groups in kernels.waves(i, j, sequence, order == "WOR", heavy):
                one = [(i[p], j[p])] + [(i[q] if side else i[q[:, 0]], j[q[:, 0]] if side else j[q]) for side, q in groups]
                for k in (0, 1):
                    axis = np.concatenate([c[k].ravel() for c in one])
                    clashes += len(axis) - len(np.unique(axis))
                seen += [p, *(q.ravel() for _, q in groups)]
            seen = np.concatenate(seen)
            rows.append((name, key[0].as_py(), len(seen), len(np.unique(seen)), float(x[seen].astype(float).sum()), clashes))
        return pa.table(dict(zip(("name", "b1", "visits", "entries", "total", "clashes"), map(list, zip(*rows)))))

    return matrix(s, d).withColumn("b1", F.col("i") % 8).groupBy("b1").applyInArrow(f, "name string, b1 long, visits long, entries long, total double, clashes long")


# --- blocks and fits --------------------------------------------------------------------------------


@query("block_tasks", f"WITH {V} SELECT i // 1429 AS b1, CASE WHEN j < 28572 THEN j // 14286 ELSE 2 + (j - 28572) // 14285 END AS b2, count(*) AS n, sum(x) AS total FROM v GROUP BY 1, 2")
def block_tasks(s, d):
    """A function on each block's entries."""
    def f(b1, b2, own):
        return pa.table({"b1": [b1], "b2": [b2], "n": [own.num_rows], "total": [float(np.sum(own.column("x").to_numpy().astype(float)))]})

    return P.per_block(matrix(s, d), Blocking(10_003, 7), Blocking(99_997, 7), f, "b1 long, b2 long, n long, total double")


def _arrays(w, h):
    return np.array([r.w for r in w.orderBy("i").collect()]), np.array([r.h for r in h.orderBy("j").collect()])


_REPLAYS = ("one block", "strata", "overlapped strata", "fresh rounds", "rounds a step old", "whole rounds", "averaged rounds", "mini-batches", "mini-batches within bounds")


@query("strata_replay", f"WITH {V}, n AS (SELECT unnest({list(_REPLAYS)}) AS name) SELECT name, (SELECT count(*) FROM v) AS entries, (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) AS vectors, CAST(0 AS BIGINT) AS far FROM n")
def strata_replay(s, d):
    """Epochs as jobs over the matrix give the vectors that plain loops over its entries in the same order give."""
    keep = Tables(s)
    p = C.dense_problem(s, d, 3)
    p = Problem(keep.put(p.v), keep.put(p.w), keep.put(p.h), p.meta, p.rank)
    v = sorted((r.i, r.j, float(r.x)) for r in p.v.collect())
    ids = [np.array(sorted(r[0] for r in f.select(c).collect())) for f, c in ((p.w, "i"), (p.h, "j"))]
    sizes_ = p.meta.size1, p.meta.size2
    n1, n2 = (np.maximum(np.bincount([e[k] for e in v], minlength=n), 1) for k, n in enumerate(sizes_))
    out = []
    for name in _REPLAYS:
        rule = sgd.Rule("Nzsl_L2", (0.5,), "SEQ", truncate=(-1.0, 0.9) if "bounds" in name else None)
        w, h = (np.zeros((n, 3)) for n in sizes_)
        for f, c, at in ((p.w, "w", w), (p.h, "h", h)):
            for r in f.collect():
                at[r[0]] = r[1]
        if name.startswith("mini"):
            dealt = parallel.dealt(p.v, 7, 1, 3, 4).collect()
            points = {}
            for r in sorted(dealt, key=lambda r: (r.place, r.i, r.j)):
                points.setdefault((r.batch, r.task), []).append((r.i, r.j, float(r.x)))
            replay.parallel(rule, 0.002, points, 4, w, h, n1, n2)
            got = parallel.epoch(p, p.w, p.h, sgd.Rule("Nzsl_L2", (0.5,), "WOR", truncate=rule.truncate), 0.002, 7, 1, 3, 4, keep)
        else:
            d1 = 1 if name == "one block" else 3
            run = sgd.Stratified(p, rule, d1, 6 if name.startswith("overlapped") else d1, keep)
            blocks = {}
            for e in v:
                blocks.setdefault(tuple(int(np.searchsorted(x.offsets, e[k], side="right")) - 1 for k, x in enumerate((run.rows, run.cols))), []).append(e)
            if "rounds" in name:
                span = {"fresh rounds": 0, "rounds a step old": 1}.get(name)
                sgd.asynchronous_round(run, 0.002, (1, 1), name.startswith("averaged"), span)
                replay.rounds(rule, 0.002, blocks, d1, d1 if span is None else span + 1, name.startswith("averaged"), w, h, n1, n2)
            else:
                run.epoch(1, 0.002, 7, "WOR")
                replay.stratified(rule, 0.002, blocks, run.plan(1, 7, "WOR"), w, h, n1, n2)
            got = run.w(), run.h()
        far = sum(int((np.abs(x - y[at]) > 1e-9).any(axis=1).sum()) for x, y, at in zip(_arrays(*got), (w, h), ids))
        out.append((name, len(v), sum(map(len, ids)), far))
    return s.createDataFrame(out, "name string, entries long, vectors long, far long")


FITS = {
    "sequential": dict(method="sgd", update="Nzsl_Nzl2(0.01)", loss="Nzsl_Nzl2(0.01)", decay="BoldDriver(0.005)", epochs=2),
    "parallel": dict(method="psgd", update="Nzsl", loss="Nzsl", decay="BoldDriver(0.005)", epochs=2, blocks=4, truncate=(-100.0, 100.0)),
    "stratified": dict(method="dsgd", update="Nzsl", regularize="Nzl2(0.01)", loss="Nzsl_Nzl2(0.01)", decay="BoldDriver(0.005)", epochs=2, blocks=4, group=2),
    "overlapped": dict(method="overlapped", update="Nzsl_L2(1)", loss="Nzsl_L2(1)", decay="Const(0.005)", epochs=1, blocks=3),
    "rounds": dict(method="asgd", update="Nzsl", loss="Nzsl", decay="Const(0.002)", epochs=2, blocks=4, balance="L2"),
    "rounds of bounded staleness": dict(method="asgd", update="Nzsl", loss="Nzsl", decay="Const(0.002)", epochs=2, blocks=4, staleness=1),
    "cache squares": dict(method="csgd", update="Nzsl", regularize="L2(0.1)", loss="Nzsl_L2(0.1)", decay="Sequential(0.005,0.5)", epochs=2, blocks=4, cache_kb=16),
    "alternating": dict(method="als", loss="Nzsl_L2(1)", epochs=3),
    "searched": dict(method="dsgd", update="Nzsl", loss="Nzsl", decay="Auto(0.01,5)", epochs=2, blocks=2),
}


def _fit_facts(name):
    def run(s, d):
        got = factorize(C.dense_problem(s, d), Spec(**FITS[name])).trace.orderBy("epoch").collect()
        return facts(s, rows=len(got), descends=got[-1].loss < got[0].loss, finite=all(np.isfinite(r.loss) for r in got))

    return run


for _name, _spec in FITS.items():
    query(f"fit_{_name.replace(' ', '_')}", facts_sql(rows=_spec["epochs"] + 1, descends=1, finite=1))(_fit_facts(_name))


@query("trace_source", """WITH t AS (SELECT n_nationkey AS e, 'list(it=' || n_nationkey || ', epoch=' || n_nationkey || ', loss=' || n_regionkey || '.5, loss_test=NaN, eps=0.25)' || CASE WHEN n_nationkey < 24 THEN ',' ELSE '' END AS line FROM nation)
    SELECT -1 AS epoch, 'run <- list(trace=list(' AS line UNION ALL SELECT e, line FROM t UNION ALL SELECT 25, '));'""")
def trace_source(s, d):
    """A trace with a row a nation, as the source of a list."""
    t = table(s, d, "nation").select(F.col("n_nationkey").alias("it"), F.col("n_nationkey").alias("epoch"), (F.col("n_regionkey") + F.lit(0.5).cast("double")).alias("loss"), F.lit(float("nan")).alias("loss_test"), F.lit(0.25).cast("double").alias("eps"))
    return N.trace_lines(t, "run").withColumn("epoch", F.col("epoch").cast("int"))


# --- small linear algebra -----------------------------------------------------------------------------


_GRAM = f"WITH {wl()} SELECT CAST(p.k AS INTEGER) AS a, CAST(q.k AS INTEGER) AS b, round(sum(p.w * q.w) + CASE WHEN p.k = q.k THEN 1 ELSE 0 END, 9) AS value FROM wl p JOIN wl q USING (i) GROUP BY p.k, q.k"


def _square(s, m) -> DataFrame:
    return rounded(s.createDataFrame([(a, b, float(m[a, b])) for a in range(len(m)) for b in range(len(m))], "a int, b int, value double"), "value", digits=9)


@query("linear_qr", _GRAM)
def linear_qr(s, d):
    """R'R + I of the triangle R of all row vectors, by a tree over blocks of 7 rows."""
    _, r = linear.tall_qr(row_factor(s, d), "i", "w", RANK, Tables(s).put, 7, 3)
    return _square(s, r.T @ r + np.eye(RANK))


@query("linear_qr_rows", f"WITH {wl()} SELECT i, CAST(k AS INTEGER) AS k, round(w, 9) AS value FROM wl")
def linear_qr_rows(s, d):
    """Q R is the table of row vectors again, row by row."""
    q, r = linear.tall_qr(row_factor(s, d), "i", "w", RANK, Tables(s).put, 7, 3)
    back = q.select("i", each(RANK, lambda b: sum((F.col("w")[a] * float(r[a, b]) for a in range(RANK)), F.lit(0.0))).alias("w"))
    return rounded(long(back, "i", "w"), "value", digits=9)


@query("linear_qr_orthogonal", f"WITH {wl()} SELECT CAST(p.k AS INTEGER) AS a, CAST(q.k AS INTEGER) AS b, count(*) AS rows, CAST(CASE WHEN p.k = q.k THEN 1 ELSE 0 END AS DOUBLE) AS value FROM wl p JOIN wl q USING (i) GROUP BY p.k, q.k")
def linear_qr_orthogonal(s, d):
    """Q'Q over all rows is the identity."""
    q = long(linear.tall_qr(row_factor(s, d), "i", "w", RANK, Tables(s).put, 7, 3)[0], "i", "w")
    pairs = q.select("i", F.col("k").alias("a"), F.col("value").alias("x")).join(q.select("i", F.col("k").alias("b"), F.col("value").alias("y")), "i")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("rows"), (F.round(F.sum(F.col("x") * F.col("y")), 6) + 0.0).alias("value"))


@query("linear_lls", _GRAM)
def linear_lls(s, d):
    """The B of W B = W (W'W + I), by least squares over the rows of W."""
    w = row_factor(s, d)
    g = linear._gram(w, "w", RANK) + np.eye(RANK)
    rhs = each(RANK, lambda b: sum((F.col("w")[a] * float(g[a, b]) for a in range(RANK)), F.lit(0.0)))
    return _square(s, linear.tall_least_squares(w.withColumn("y", rhs), "i", "w", "y", RANK, RANK, Tables(s).put, 7, 3))


def _systems(s, d) -> DataFrame:
    """Of each supplier with parts the normal equations of its row: the Gram matrix of its parts' vectors plus the identity, and the sums of x h."""
    v = matrix(s, d).join(column_factor(s, d), "j")
    h = F.col("h")
    sums = v.groupBy("i").agg(*(F.sum(h[a] * h[b]).alias(f"g{a}_{b}") for a in range(RANK) for b in range(RANK)), *(F.sum(F.col("x") * h[k]).alias(f"b{k}") for k in range(RANK)))
    return sums.select("i", F.array(*(F.col(f"g{a}_{b}") + (1.0 if a == b else 0.0) for a in range(RANK) for b in range(RANK))).alias("m"), each(RANK, lambda k: F.col(f"b{k}").cast("double")).alias("b"))


@query("linear_lu", f"WITH {V}, {C.hl()} SELECT v.i, CAST(p.k AS INTEGER) AS a, CAST(q.k AS INTEGER) AS b, round(sum(p.h * q.h) + CASE WHEN p.k = q.k THEN 1 ELSE 0 END, 9) AS value FROM v JOIN hl p USING (j) JOIN hl q USING (j) GROUP BY v.i, p.k, q.k")
def linear_lu(s, d):
    """Each row's matrix, put together again from its factors L and U and its row order."""
    ship(s)

    def run(batches):
        for batch in batches:
            m = batch.column("lu").flatten().to_numpy().reshape(-1, RANK, RANK)
            order = batch.column("order").flatten().to_numpy().reshape(-1, RANK)
            back = np.empty_like(m)
            np.put_along_axis(back, order[:, :, None], (np.tril(m, -1) + np.eye(RANK)) @ np.triu(m), axis=1)
            at = np.indices(m.shape)
            yield pa.RecordBatch.from_pydict({"i": np.repeat(batch.column("i").to_numpy(), RANK * RANK), "a": at[1].ravel().astype(np.int32), "b": at[2].ravel().astype(np.int32), "value": back.ravel()})

    return rounded(linear.lu_rows(_systems(s, d), "i", "m", RANK).mapInArrow(run, "i long, a int, b int, value double"), "value", digits=9)


@query("linear_solve", f"WITH {V}, {C.hl()} SELECT v.i, CAST(k AS INTEGER) AS k, round(sum(x * h), 6) AS rhs FROM v JOIN hl USING (j) GROUP BY v.i, k")
def linear_solve(s, d):
    """Each row's matrix times the solution of its system is the right-hand side."""
    systems = Tables(s).put(_systems(s, d))
    got = linear.lu_rows(systems, "i", "m", RANK, "b").join(systems, "i")
    back = got.select("i", each(RANK, lambda a: sum((F.col("m")[a * RANK + k] * F.col("solution")[k] for k in range(RANK)), F.lit(0.0))).alias("b"))
    return rounded(long(back, "i", "b", "rhs"), "rhs")


@query("svd_start_product", f"WITH cells AS (SELECT count(*) AS cells FROM supplier, part) SELECT cells, CAST(0 AS BIGINT) AS far FROM cells")
def svd_start_product(s, d):
    """A full matrix of rank 2: its leading two singular triples give it back, cell by cell."""
    w, h = row_factor(s, d, 2), column_factor(s, d, 2)
    keep = Tables(s).put
    v = keep(w.crossJoin(h).select("i", "j", dot("w", "h", 2).alias("x")))  # every cell of a full matrix is the input here
    a, b = linear.svd_start(v, G.factor(s, sizes(s, d).size2, 2, "Normal(0,1)", 3, "j", "h"), 2, keep)
    back = v.join(a, "i", "left").join(b, "j", "left").select("x", F.coalesce(dot("w", "h", 2), F.lit(0.0)).alias("y"))
    return back.agg(F.count("*").alias("cells"), F.count_if(F.abs(F.col("x") - F.col("y")) > 1e-6).alias("far"))


# --- looking into factors and logs ----------------------------------------------------------------------

_COS = C._COS.replace("CAST(a.embedding[k] AS DOUBLE)", "exp(CAST(a.embedding[k] AS DOUBLE))").replace("CAST(b.embedding[k] AS DOUBLE)", "exp(CAST(b.embedding[k] AS DOUBLE))")
_NRM = "sqrt(list_sum(list_transform(range(1, 65), lambda k: exp(CAST({t}.embedding[k] AS DOUBLE)) ** 2)))"
query("cos_dist_exp", f"SELECT a.vec_id AS a, b.vec_id AS b, round(1 - {_COS} / ({_NRM.format(t='a')} * {_NRM.format(t='b')}), 6) AS distance FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 50 = 0")(
    lambda s, d: rounded(N.cosine_distances(C._vectors(s, d).filter("id % 50 = 0"), C._vectors(s, d), 64, exp=True), "distance")
)


@query("event_slot_facts", C._SEC + "SELECT user_id AS rank, count(*) AS tasks, CAST(0 AS BIGINT) AS overlaps FROM sec WHERE stop IS NOT NULL GROUP BY 1")
def event_slot_facts(s, d):
    """Every task has a slot, and no two tasks of one slot overlap."""
    t = _sections(s, d).filter("stop is not null").select(F.col("user_id").alias("rank"), F.col("start").alias("task"), F.col("start").cast("double").alias("start"), F.col("stop").cast("double").alias("stop"))
    placed = N.slots(t).join(t, ["rank", "task"])
    from pyspark.sql.window import Window

    last = F.max("stop").over(Window.partitionBy("rank", "slot").orderBy("start", "task").rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("last", last).groupBy("rank").agg(F.count("*").alias("tasks"), F.sum(F.when(F.col("last") > F.col("start"), 1).otherwise(0)).alias("overlaps"))


_PEAK = """t AS (SELECT start, stop FROM sec WHERE stop IS NOT NULL), ev AS (SELECT start AS moment, 1 AS d FROM t UNION ALL SELECT stop, -1 FROM t),
    run AS (SELECT sum(d) OVER (ORDER BY moment, d ROWS UNBOUNDED PRECEDING) AS n FROM ev)"""


@query("event_slots_of_one_rank", C._SEC.rstrip() + f", {_PEAK} SELECT (SELECT count(*) FROM t) AS tasks, (SELECT CAST(max(n) AS BIGINT) FROM run) AS slots, CAST(0 AS BIGINT) AS overlaps")
def event_slots_of_one_rank(s, d):
    """All tasks of all users as one rank's: as many slots as ever run at once, and no two tasks of one slot overlap."""
    t = _sections(s, d).filter("stop is not null").select(F.lit(1).alias("rank"), F.col("start").alias("task"), F.col("start").cast("double").alias("start"), F.col("stop").cast("double").alias("stop"))
    t = Tables(s).put(t)
    placed = N.spread_slots(t, Tables(s).put).join(t, ["rank", "task"])
    from pyspark.sql.window import Window

    last = F.max("stop").over(Window.partitionBy("slot").orderBy("start", "task").rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("last", last).agg(F.count("*").alias("tasks"), F.countDistinct("slot").alias("slots"), F.sum(F.when(F.col("last") > F.col("start"), 1).otherwise(0)).alias("overlaps"))


# --- tools ----------------------------------------------------------------------------------------------


def _input(s, d, name="m.parquet"):
    path = _path(s, name)
    matrix(s, d).write.parquet(path)
    return path, path.rsplit("/", 1)[0]


@query("tool_convert", f"WITH {V} SELECT i, j, x FROM v")
def tool_convert(s, d):
    path, at = _input(s, d)
    main(["convert", path, f"{at}/m.mmc"], s)
    main(["convert", f"{at}/m.mmc", f"{at}/m.csv"], s)
    return M.read_matrix(s, f"{at}/m.csv")[0]


@query("tool_apply", f"WITH {V} SELECT i, j, x * 2 + i AS x FROM v")
def tool_apply(s, d):
    path, at = _input(s, d)
    main(["apply", path, "x * 2 + i", f"{at}/out.parquet"], s)
    return s.read.parquet(f"{at}/out.parquet")


@query("tool_center", f"WITH {V} SELECT i, j, round(x - (SELECT avg(x) FROM v), 6) AS x FROM v")
def tool_center(s, d):
    path, at = _input(s, d)
    main(["center", path, f"{at}/out.parquet"], s)
    return rounded(s.read.parquet(f"{at}/out.parquet"), "x")


@query("tool_project", f"WITH {V}, {C._FREQ.format(t=20)} SELECT r.new AS i, c.new AS j, x FROM v JOIN r ON r.old = v.i JOIN c ON c.old = v.j")
def tool_project(s, d):
    path, at = _input(s, d)
    main(["project", path, f"{at}/out", "--threshold", "20"], s)
    return s.read.parquet(f"{at}/out/data")


@query("tool_block", f"WITH {V} SELECT i, j, x FROM v")
def tool_block(s, d):
    path, at = _input(s, d)
    main(["block", path, f"{at}/out", "--blocks1", "2", "--blocks2", "3"], s)
    return K.read_blocked(s, f"{at}/out")[0]


@query("tool_sample", f"WITH {V} " + facts_sql(rows="(SELECT greatest(1, (max(i) + 1) // 2) FROM v)", columns="(SELECT greatest(1, (max(j) + 1) // 2) FROM v)"))
def tool_sample(s, d):
    path, at = _input(s, d)
    main(["sample", path, f"{at}/out", "--fraction", "0.5"], s)
    return facts(s, rows=s.read.parquet(f"{at}/out/map1").count(), columns=s.read.parquet(f"{at}/out/map2").count())


@query("tool_prepare", facts_sql(row_factors_fit=1, column_factors_fit=1, rare_rows=0, rank=4))
def tool_prepare(s, d):
    path, at = _input(s, d)
    main(["prepare", path, f"{at}/out", "--fraction", "0.5", "--threshold", "3", "--rank", "4"], s)
    n = {x: s.read.parquet(f"{at}/out/{x}") for x in ("map1", "map2", "w", "h")}
    sample = P.random_submatrix(matrix(s, d), sizes(s, d), *G.sample_sizes(sizes(s, d), 0, fraction=0.5), 1).data
    rare = sample.groupBy("i").count().filter("count <= 3").join(n["map1"].select(F.col("old").alias("i")), "i").count()
    return facts(s, row_factors_fit=n["w"].count() == n["map1"].count(), column_factors_fit=n["h"].count() == n["map2"].count(), rare_rows=rare, rank=len(n["w"].first().w))


def _sizes_as_arguments(s, d, *more) -> list[str]:
    m = _like_matrix(s, d)
    return ["--size1", str(m.size1), "--size2", str(m.size2), "--nnz", str(m.nnz), "--nnz-test", str(m.nnz // 10), "--rank", "3"]


@query("tool_generate", _sized(train="n", test="n // 10", rows="r", columns="c", described=0))
def tool_generate(s, d):
    """A problem with the sizes of the matrix written out, and the same one by way of its description."""
    path = _path(s, "g")
    at, args = path.rsplit("/", 1)[0], _sizes_as_arguments(s, d)
    main(["generate", path, *args], s)
    main(["describe", f"{at}/p.rm", *args], s)
    train = s.read.parquet(f"{path}/train.parquet")
    return facts(s, train=train.count(), test=s.read.parquet(f"{path}/test.parquet").count(), rows=s.read.parquet(f"{path}/w").count(), columns=s.read.parquet(f"{path}/h").count(), described=train.exceptAll(described.open_matrix(s, f"{at}/p.rm")[0]).count())


@query("tool_factors", _sized(rows="r", columns="c", rank=3, inside=1))
def tool_factors(s, d):
    path = _path(s, "f")
    main(["factors", path, "--size1", str(sizes(s, d).size1), "--size2", str(sizes(s, d).size2), "--rank", "3", "--values", "Uniform(1,2)"], s)
    w, h = s.read.parquet(f"{path}/w"), s.read.parquet(f"{path}/h")
    low = w.select(F.array_min("w")).agg(F.min("array_min(w)")).first()[0]
    return facts(s, rows=w.count(), columns=h.count(), rank=len(h.first().h), inside=1 < low < 2)


@query("tool_factorize", facts_sql(trace_rows=4, lines=6, descends=1, rank=3))
def tool_factorize(s, d):
    path, at = _input(s, d)
    main(["factorize", path, "-", "-", f"{at}/out", "--method", "als", "--loss", "Nzsl_L2(0.1)", "--epochs", "3", "--rank", "3"], s)
    trace = s.read.parquet(f"{at}/out/trace").orderBy("epoch").collect()
    return facts(s, trace_rows=len(trace), lines=s.read.text(f"{at}/out/trace.R").count(), descends=trace[-1].loss < trace[0].loss, rank=len(s.read.parquet(f"{at}/out/w").first().w))


@query("tool_demo", facts_sql(trace_rows=2, descends=1))
def tool_demo(s, d):
    path, at = _input(s, d)
    main(["demo", path, f"{at}/out", "--rank", "5", "--epochs", "1"], s)
    trace = s.read.parquet(f"{at}/out/trace").orderBy("epoch").collect()
    return facts(s, trace_rows=len(trace), descends=trace[-1].loss < trace[0].loss)
