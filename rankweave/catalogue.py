"""Named queries over the driver's tables, with the SQL that gives the same rows.

The matrix is supplier x part with the summed quantity of ``lineitem``; factors are dyadic, so sums
of products are exact in binary64 whatever the order.  Results with division, logarithm or root
are rounded on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import decay as D
from .functions.vectors import dot, each, long
from .model import Blocking, MatrixMeta, Problem
from .operators import aggregate as A
from .operators import analysis as N
from .operators import balance as B
from .operators import loss as L
from .operators import regularize as R
from .operators import reshape as P
from .operators import scale as S
from .operators import update as U
from .plans import als, multiplicative
from .plans.factorize import Spec, factorize
from .plans.schedule import sequential
from .plans.store import Tables
from .sources import blocked as K
from .sources import generate as G
from .sources import matrix_market as M
from .streaming import entries as E

RANK = 4
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# --- inputs -------------------------------------------------------------------------------------


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def matrix(s, d) -> DataFrame:
    return table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.sum("l_quantity").alias("x"))


def _dyadic(index, a, b, r, plus=0):
    return each(r, lambda k: ((a * F.col(index) + b * k) % 16 + plus) / F.lit(16.0))


def row_factor(s, d, r=RANK, plus=0) -> DataFrame:
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("i")).withColumn("w", _dyadic("i", 7, 13, r, plus))


def column_factor(s, d, r=RANK, plus=0) -> DataFrame:
    return table(s, d, "part").select(F.col("p_partkey").alias("j")).withColumn("h", _dyadic("j", 5, 11, r, plus))


def signed_factor(df: DataFrame, c: str, r=RANK) -> DataFrame:
    return df.withColumn(c, each(r, lambda k: F.col(c)[k] - 0.5))


def sizes(s, d) -> MatrixMeta:
    """Numbers of rows and columns: the largest ids of the tables and 1."""
    top = lambda name, key: table(s, d, name).agg(F.max(key)).first()[0]
    return MatrixMeta(top("supplier", "s_suppkey") + 1, top("part", "p_partkey") + 1)


def problem_parts(s, d, r=RANK, plus=0):
    return matrix(s, d), row_factor(s, d, r, plus), column_factor(s, d, r, plus)


V = "v AS (SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity) AS x FROM lineitem GROUP BY 1, 2)"


def wl(r=RANK, plus=0, shift=""):
    return f"wl AS (SELECT s_suppkey AS i, k, CAST((7*s_suppkey + 13*k) % 16 + {plus} AS DOUBLE) / 16 {shift} AS w FROM supplier, range({r}) t(k))"


def hl(r=RANK, plus=0, shift=""):
    return f"hl AS (SELECT p_partkey AS j, k, CAST((5*p_partkey + 11*k) % 16 + {plus} AS DOUBLE) / 16 {shift} AS h FROM part, range({r}) t(k))"


def e_(first=0):
    return f"""e AS (SELECT v.i, v.j, v.x, d.dot FROM v JOIN (SELECT v.i, v.j, sum(CASE WHEN wl.k >= {first} THEN w * h ELSE 0 END) AS dot FROM v
        JOIN wl ON wl.i = v.i JOIN hl ON hl.j = v.j AND hl.k = wl.k GROUP BY 1, 2) d ON d.i = v.i AND d.j = v.j)"""


N1 = "n1 AS (SELECT i, count(*) AS n FROM v GROUP BY 1), n2 AS (SELECT j, count(*) AS n FROM v GROUP BY 1)"
BASE = f"WITH {V}, {wl()}, {hl()}, {e_()}, {N1} "
POSITIVE = f"WITH {V}, {wl(plus=1)}, {hl(plus=1)}, {e_()}, {N1} "


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# --- totals -------------------------------------------------------------------------------------

query("nnz_total", f"WITH {V} SELECT count(*) AS nnz FROM v")(lambda s, d: A.nnz(matrix(s, d)))
query("nnz_rows", f"WITH {V} SELECT s_suppkey AS i, count(v.i) AS nnz FROM supplier LEFT JOIN v ON v.i = s_suppkey GROUP BY 1")(lambda s, d: A.nnz_of(matrix(s, d), "i", row_factor(s, d)))
query("nnz_cols", f"WITH {V} SELECT p_partkey AS j, count(v.j) AS nnz FROM part LEFT JOIN v ON v.j = p_partkey GROUP BY 1")(lambda s, d: A.nnz_of(matrix(s, d), "j", column_factor(s, d)))
query("nnz12max", f"WITH {V}, {N1} SELECT greatest((SELECT max(n) FROM n1), (SELECT max(n) FROM n2)) AS nnz_max")(lambda s, d: A.nnz_max(matrix(s, d)))
query("sum_all", f"WITH {V} SELECT sum(x) AS total FROM v")(lambda s, d: A.total(matrix(s, d)))
query("mean_all", f"WITH {V} SELECT round(avg(x), 6) AS mean FROM v")(lambda s, d: rounded(A.mean(matrix(s, d)), "mean"))
query("l1", f"WITH {V} SELECT sum(abs(x)) AS l1 FROM v")(lambda s, d: A.absolute_sum(matrix(s, d)))
query("l2", f"WITH {V} SELECT sum(x * x) AS l2 FROM v")(lambda s, d: A.square_sum(matrix(s, d)))
query("col_sums_w", f"WITH {wl()} SELECT CAST(k AS INTEGER) AS k, sum(w) AS total FROM wl GROUP BY 1")(lambda s, d: A.component_sums(row_factor(s, d), "w", RANK))
query("row_sums_h", f"WITH {hl()} SELECT CAST(k AS INTEGER) AS k, sum(h) AS total FROM hl GROUP BY 1")(lambda s, d: A.component_sums(column_factor(s, d), "h", RANK))
query("row_sums_w", f"WITH {wl()} SELECT i, sum(w) AS total FROM wl GROUP BY 1")(lambda s, d: A.vector_sums(row_factor(s, d), "i", "w", RANK))
query("col_sums_h", f"WITH {hl()} SELECT j, sum(h) AS total FROM hl GROUP BY 1")(lambda s, d: A.vector_sums(column_factor(s, d), "j", "h", RANK))
query("sq_sums_w", f"WITH {wl()} SELECT CAST(k AS INTEGER) AS k, sum(w * w) AS total FROM wl GROUP BY 1")(lambda s, d: A.component_square_sums(row_factor(s, d), "w", RANK))
query("sq_sums_h", f"WITH {hl()} SELECT CAST(k AS INTEGER) AS k, sum(h * h) AS total FROM hl GROUP BY 1")(lambda s, d: A.component_square_sums(column_factor(s, d), "h", RANK))
query("nzl2_sq_sums_w", BASE + "SELECT CAST(k AS INTEGER) AS k, sum(n * w * w) AS total FROM wl JOIN n1 USING (i) GROUP BY 1")(
    lambda s, d: A.weighted_square_sums(row_factor(s, d), A.nnz_of(matrix(s, d), "i"), "i", "w", RANK)
)
query("nzl2_sq_sums_h", BASE + "SELECT CAST(k AS INTEGER) AS k, sum(n * h * h) AS total FROM hl JOIN n2 USING (j) GROUP BY 1")(
    lambda s, d: A.weighted_square_sums(column_factor(s, d), A.nnz_of(matrix(s, d), "j"), "j", "h", RANK)
)
query("crossprod_w", f"WITH {wl()} SELECT CAST(p.k AS INTEGER) AS a, CAST(q.k AS INTEGER) AS b, sum(p.w * q.w) AS value FROM wl p JOIN wl q USING (i) GROUP BY 1, 2")(
    lambda s, d: A.gram(row_factor(s, d), "w", RANK)
)
query("tcrossprod_h", f"WITH {hl()} SELECT CAST(p.k AS INTEGER) AS a, CAST(q.k AS INTEGER) AS b, sum(p.h * q.h) AS value FROM hl p JOIN hl q USING (j) GROUP BY 1, 2")(
    lambda s, d: A.gram(column_factor(s, d), "h", RANK)
)
_G = f"WITH {wl()}, {hl()}, gw AS (SELECT p.k AS a, q.k AS b, sum(p.w * q.w) AS g FROM wl p JOIN wl q USING (i) GROUP BY 1, 2), gh AS (SELECT p.k AS a, q.k AS b, sum(p.h * q.h) AS g FROM hl p JOIN hl q USING (j) GROUP BY 1, 2) "
query("sum_of_squares", _G + "SELECT sum(gw.g * gh.g) AS total FROM gw JOIN gh USING (a, b)")(lambda s, d: A.product_square_sum(row_factor(s, d), column_factor(s, d), RANK))
query("sum_of_prod", f"WITH {wl()}, {hl()} SELECT sum(a * b) AS total FROM (SELECT k, sum(w) AS a FROM wl GROUP BY 1) JOIN (SELECT k, sum(h) AS b FROM hl GROUP BY 1) USING (k)")(
    lambda s, d: A.product_sum(row_factor(s, d), column_factor(s, d), RANK)
)

# --- losses -------------------------------------------------------------------------------------

query("loss_nzsl", BASE + "SELECT sum((x - dot) * (x - dot)) AS loss FROM e")(lambda s, d: L.squared(*problem_parts(s, d), RANK))
query("loss_nzrmse", BASE + "SELECT round(sqrt(sum((x - dot) * (x - dot)) / count(*)), 6) AS loss FROM e")(lambda s, d: rounded(L.rmse(*problem_parts(s, d), RANK), "loss"))
query("loss_sl_data", BASE + "SELECT sum(x * x - 2 * x * dot) AS loss FROM e")(lambda s, d: L.full_squared_data(*problem_parts(s, d), RANK))
query("loss_sl_model", _G + "SELECT sum(gw.g * gh.g) AS loss FROM gw JOIN gh USING (a, b)")(lambda s, d: L.full_squared_model(row_factor(s, d), column_factor(s, d), RANK))
query("loss_sl", _G.rstrip() + f", {V}, {e_()} SELECT (SELECT sum(gw.g * gh.g) FROM gw JOIN gh USING (a, b)) + (SELECT sum(x * x - 2 * x * dot) FROM e) AS loss")(
    lambda s, d: L.full_squared(*problem_parts(s, d), RANK)
)
query("loss_gkl_data", POSITIVE + "SELECT round(sum(x * ln(x / dot) - x), 3) AS loss FROM e WHERE x <> 0")(lambda s, d: rounded(L.kl_data(*problem_parts(s, d, plus=1), RANK), "loss", digits=3))
query("loss_gkl_model", f"WITH {wl(plus=1)}, {hl(plus=1)} SELECT sum(a * b) AS loss FROM (SELECT k, sum(w) AS a FROM wl GROUP BY 1) JOIN (SELECT k, sum(h) AS b FROM hl GROUP BY 1) USING (k)")(
    lambda s, d: L.gkl_model(row_factor(s, d, plus=1), column_factor(s, d, plus=1), RANK)
)
query("loss_gkl", POSITIVE + """SELECT round(greatest(0, (SELECT sum(x * ln(x / dot) - x) FROM e WHERE x <> 0) +
    (SELECT sum(a * b) FROM (SELECT k, sum(w) AS a FROM wl GROUP BY 1) JOIN (SELECT k, sum(h) AS b FROM hl GROUP BY 1) USING (k))), 3) AS loss""")(
    lambda s, d: rounded(L.gkl(*problem_parts(s, d, plus=1), RANK), "loss", digits=3)
)
query("loss_kl", POSITIVE + "SELECT round(sum(x * ln(x / dot)), 3) AS loss FROM e WHERE x <> 0")(lambda s, d: rounded(L.kl(*problem_parts(s, d, plus=1), RANK), "loss", digits=3))
query("loss_l1", f"WITH {wl(shift='- 0.5')}, {hl(shift='- 0.5')} SELECT 0.5 * (SELECT sum(abs(w)) FROM wl) + 0.25 * (SELECT sum(abs(h)) FROM hl) AS loss")(
    lambda s, d: L.l1(signed_factor(row_factor(s, d), "w"), signed_factor(column_factor(s, d), "h"), RANK, 0.5, 0.25)
)
query("loss_l2", f"WITH {wl()}, {hl()} SELECT 0.5 * ((SELECT sum(w * w) FROM wl) + (SELECT sum(h * h) FROM hl)) AS loss")(lambda s, d: L.l2(row_factor(s, d), column_factor(s, d), RANK, 0.5))
_NZ = "0.5 * ((SELECT sum(n * w * w) FROM wl JOIN n1 USING (i)) + (SELECT sum(n * h * h) FROM hl JOIN n2 USING (j)))"
query("loss_nzl2", BASE + f"SELECT {_NZ} AS loss")(lambda s, d: L.weighted_l2(*problem_parts(s, d), RANK, 0.5))
_BIASED = f"WITH {V}, {wl()}, {hl()}, {e_(1)}, {N1} "
query("loss_biased_nzsl", _BIASED + "SELECT sum(q * q) AS loss FROM (SELECT x - dot - w - h AS q FROM e JOIN wl ON wl.i = e.i AND wl.k = 0 JOIN hl ON hl.j = e.j AND hl.k = 0)")(
    lambda s, d: L.biased_squared(*problem_parts(s, d), RANK)
)
query("loss_biased_nzl2", BASE + """SELECT (SELECT sum(CASE WHEN k = 0 THEN 0.125 ELSE 0.5 END * n * w * w) FROM wl JOIN n1 USING (i)) +
    (SELECT sum(CASE WHEN k = 0 THEN 0.0625 ELSE 0.25 END * n * h * h) FROM hl JOIN n2 USING (j)) AS loss""")(
    lambda s, d: L.biased_weighted_l2(*problem_parts(s, d), RANK, 0.5, 0.25, 0.125, 0.0625)
)
query("loss_sum_nzsl_nzl2", BASE + f"SELECT (SELECT sum((x - dot) * (x - dot)) FROM e) + {_NZ} AS loss")(
    lambda s, d: L.summed(L.squared(*problem_parts(s, d), RANK), L.weighted_l2(*problem_parts(s, d), RANK, 0.5))
)
query("loss_none", f"WITH {V} SELECT count(*) AS entries, CAST(0 AS DOUBLE) AS loss FROM v")(lambda s, d: A.nnz(matrix(s, d)).withColumnRenamed("nnz", "entries").crossJoin(L.nothing(s)))  # one row each

# --- projection, blocks, reshape ----------------------------------------------------------------

query("center_train", f"WITH {V} SELECT i, j, round(x - (SELECT avg(x) FROM v), 6) AS x FROM v")(lambda s, d: rounded(P.centred(matrix(s, d)).select("i", "j", "x"), "x"))
query("center_test", f"WITH {V} SELECT i, j, round(x - (SELECT avg(x) FROM v WHERE (i + j) % 5 <> 0), 6) AS x FROM v WHERE (i + j) % 5 = 0")(
    lambda s, d: rounded(P.centred(matrix(s, d).filter("(i + j) % 5 <> 0"), matrix(s, d).filter("(i + j) % 5 = 0")).select("i", "j", "x"), "x")
)
_OP = "v AS (SELECT l_orderkey AS i, l_partkey AS j, sum(l_quantity) AS x FROM lineitem GROUP BY 1, 2)"


def order_matrix(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.sum("l_quantity").alias("x"))


_FREQ = """r AS (SELECT i AS old, row_number() OVER (ORDER BY i) - 1 AS new FROM (SELECT i FROM v GROUP BY 1 HAVING count(*) > {t})),
    c AS (SELECT j AS old, row_number() OVER (ORDER BY j) - 1 AS new FROM (SELECT j FROM v GROUP BY 1 HAVING count(*) > {t}))"""
query("project_frequent", f"WITH {_OP}, {_FREQ.format(t=4)} SELECT r.new AS i, c.new AS j, x FROM v JOIN r ON r.old = v.i JOIN c ON c.old = v.j")(lambda s, d: P.frequent(order_matrix(s, d), 4).data)
query("project_frequent_maps", f"WITH {_OP}, {_FREQ.format(t=4)} SELECT new, old FROM r")(lambda s, d: P.frequent(order_matrix(s, d), 4).map1)
query("project_nonempty", f"WITH {_OP}, {_FREQ.format(t=0)} SELECT r.new AS i, c.new AS j, x FROM v JOIN r ON r.old = v.i JOIN c ON c.old = v.j")(lambda s, d: P.nonempty(order_matrix(s, d)).data)


@query("project_twice_maps", f"""WITH {_OP}, {_FREQ.format(t=2)}, u AS (SELECT r.new AS i, c.new AS j FROM v JOIN r ON r.old = v.i JOIN c ON c.old = v.j),
    q AS (SELECT i AS mid, row_number() OVER (ORDER BY i) - 1 AS new FROM (SELECT i FROM u GROUP BY 1 HAVING count(*) > 4)) SELECT q.new, r.old FROM q JOIN r ON r.new = q.mid""")
def project_twice(s, d):
    return P.frequent(P.frequent(order_matrix(s, d), 2), 4).map1


@query("project_submatrix", f"""WITH {V}, r AS (SELECT s_suppkey AS old, row_number() OVER (ORDER BY s_suppkey) - 1 AS new FROM supplier WHERE s_suppkey % 3 = 0),
    c AS (SELECT p_partkey AS old, row_number() OVER (ORDER BY p_partkey) - 1 AS new FROM part WHERE p_partkey % 2 = 0)
    SELECT r.new AS i, c.new AS j, x FROM v JOIN r ON r.old = v.i JOIN c ON c.old = v.j""")
def project_submatrix(s, d):
    rows = P.renumbered(table(s, d, "supplier").filter("s_suppkey % 3 = 0"), "s_suppkey")
    cols = P.renumbered(table(s, d, "part").filter("p_partkey % 2 = 0"), "p_partkey")
    return P.submatrix(matrix(s, d), rows, cols).data


query("project_subrange", f"WITH {V} SELECT i - 2 AS i, j - 10 AS j, x FROM v WHERE i >= 2 AND i < 9 AND j >= 10 AND j < 150")(lambda s, d: P.subrange(matrix(s, d), 2, 9, 10, 150))


@query("kcore", f"""WITH RECURSIVE {_OP}, """ + ", ".join(
    f"v{n + 1} AS (SELECT * FROM v{n or ''} WHERE i IN (SELECT i FROM v{n or ''} GROUP BY 1 HAVING count(*) > 4) AND j IN (SELECT j FROM v{n or ''} GROUP BY 1 HAVING count(*) > 4))" for n in range(12)
) + """, r AS (SELECT i AS old, row_number() OVER (ORDER BY i) - 1 AS new FROM (SELECT DISTINCT i FROM v12)), c AS (SELECT j AS old, row_number() OVER (ORDER BY j) - 1 AS new FROM (SELECT DISTINCT j FROM v12))
    SELECT r.new AS i, c.new AS j, x FROM v12 JOIN r ON r.old = i JOIN c ON c.old = j""")
def kcore(s, d):
    return P.core(order_matrix(s, d), 4, Tables(s).put).data


@query("gather_rows", f"WITH {wl()}, p AS (SELECT s_suppkey AS pos, s_suppkey * 7 % 10 + 1 AS i FROM supplier) SELECT pos, p.i, CAST(k AS INTEGER) AS k, w AS value FROM p JOIN wl ON wl.i = p.i")
def gather_rows(s, d):
    wanted = table(s, d, "supplier").select(F.col("s_suppkey").alias("pos"), (F.col("s_suppkey") * 7 % 10 + 1).alias("i"))
    return P.gather(row_factor(s, d), "i", "w", wanted).select("pos", "i", F.posexplode("w").alias("k", "value"))


_BLOCK = "CASE WHEN {c} < 4 * {a} THEN {c} // {a} ELSE 4 + ({c} - 4 * {a}) // {b} END"


@query("block_ids", f"""WITH {V} SELECT i, j, x, CAST(i // 1429 + 0 AS BIGINT) AS b1, CAST(CASE WHEN j < 2 * 14286 THEN j // 14286 ELSE 2 + (j - 28572) // 14285 END AS BIGINT) AS b2
    FROM v""")
def block_ids(s, d):
    """Suppliers as 10,003 rows in 7 blocks of 1,429, parts as 99,997 columns in 7 blocks."""
    return P.with_blocks(matrix(s, d), Blocking(10_003, 7), Blocking(99_997, 7))


query("block_nnz", f"WITH {V} SELECT i // 1429 AS b1, CASE WHEN j < 28572 THEN j // 14286 ELSE 2 + (j - 28572) // 14285 END AS b2, count(*) AS n FROM v GROUP BY 1, 2")(
    lambda s, d: P.with_blocks(matrix(s, d), Blocking(10_003, 7), Blocking(99_997, 7)).groupBy("b1", "b2").agg(F.count("*").alias("n"))
)
query("csgd_block_ids", f"WITH {V} SELECT i, j, x, least(i // 14, 6) AS b1, least(j // 285, 6) AS b2 FROM v")(lambda s, d: P.square_blocks(matrix(s, d), MatrixMeta(100, 2000), 7))
query("split_indexes", """WITH p AS (SELECT p_partkey AS j FROM part), n AS (SELECT (max(j) + 1) // 6 AS least, (max(j) + 1) % 6 AS over FROM p),
    b AS (SELECT j, least, over, CASE WHEN j < over * (least + 1) THEN j // (least + 1) ELSE over + (j - over * (least + 1)) // least END AS block FROM p, n)
    SELECT j, block, j - block * least - least(block, over) AS offset FROM b""")(
    lambda s, d: P.split_indexes(column_factor(s, d), "j", Blocking(sizes(s, d).size2, 6))
)
query("copy_by_columns", f"WITH {V} SELECT i, j, x FROM v")(lambda s, d: P.by_columns(matrix(s, d)))
query("apply_expression", f"WITH {V} SELECT i, j, CASE WHEN i >= 2 AND i < 8 THEN x * 2 + 1 ELSE x END AS x FROM v")(lambda s, d: P.mapped(matrix(s, d), "x * 2 + 1", rows=(2, 8)))

# --- scaling and element-wise -------------------------------------------------------------------

_W = lambda df, v="w": long(df, "i", v)
_WSIGN = f"WITH {wl(shift='- 0.5')} "


def other_factor(s, d):
    return row_factor(s, d).withColumn("w", _dyadic("i", 3, 5, RANK))


_O = f"ol AS (SELECT s_suppkey AS i, k, CAST((3*s_suppkey + 5*k) % 16 AS DOUBLE) / 16 AS o FROM supplier, range({RANK}) t(k))"
query("scale_w", f"WITH {wl()} SELECT i, CAST(k AS INTEGER) AS k, w * 3 AS value FROM wl")(lambda s, d: _W(S.times(row_factor(s, d), "w", RANK, 3.0)))
query("divide_w", f"WITH {wl()} SELECT i, CAST(k AS INTEGER) AS k, w / 4 AS value FROM wl")(lambda s, d: _W(S.divided(row_factor(s, d), "w", RANK, 4.0)))
query("scale_h_components", f"WITH {hl()} SELECT j, CAST(k AS INTEGER) AS k, h * (k + 1) AS value FROM hl")(
    lambda s, d: long(S.times_components(column_factor(s, d), "h", RANK, [1.0, 2.0, 3.0, 4.0]), "j", "h")
)
query("divide_h_components", f"WITH {hl()} SELECT j, CAST(k AS INTEGER) AS k, h / (2 ** k) AS value FROM hl")(
    lambda s, d: long(S.divided_components(column_factor(s, d), "h", RANK, [1.0, 2.0, 4.0, 8.0]), "j", "h")
)
query("scale_w_rows", f"WITH {wl()} SELECT i, CAST(k AS INTEGER) AS k, w * (i % 5) AS value FROM wl")(
    lambda s, d: _W(S.times_index(row_factor(s, d), "i", "w", RANK, row_factor(s, d).select("i", (F.col("i") % 5).cast("double").alias("c"))))
)
query("divide_w_rows", f"WITH {wl()} SELECT i, CAST(k AS INTEGER) AS k, round(w / (i % 5 + 1), 9) AS value FROM wl")(
    lambda s, d: rounded(_W(S.divided_index(row_factor(s, d), "i", "w", RANK, row_factor(s, d).select("i", (F.col("i") % 5 + 1).cast("double").alias("c")))), "value", digits=9)
)
query("hadamard", f"WITH {wl()}, {_O} SELECT i, CAST(k AS INTEGER) AS k, w * o AS value FROM wl JOIN ol USING (i, k)")(lambda s, d: _W(S.hadamard(row_factor(s, d), other_factor(s, d), "i", "w", RANK)))
query("div0", f"WITH {wl()}, {_O} SELECT i, CAST(k AS INTEGER) AS k, CASE WHEN o = 0 THEN 0 ELSE round(w / o, 9) END AS value FROM wl JOIN ol USING (i, k)")(
    lambda s, d: rounded(_W(S.quotient0(row_factor(s, d), other_factor(s, d), "i", "w", RANK)), "value", digits=9)
)
query("abs_w", _WSIGN + "SELECT i, CAST(k AS INTEGER) AS k, abs(w) AS value FROM wl")(lambda s, d: _W(S.absolute(signed_factor(row_factor(s, d), "w"), "w", RANK)))
query("truncate_w", _WSIGN + "SELECT i, CAST(k AS INTEGER) AS k, CASE WHEN w <= -0.25 THEN -0.25 + 0.0625 WHEN w >= 0.25 THEN 0.25 - 0.0625 ELSE w END AS value FROM wl")(
    lambda s, d: _W(S.truncated(signed_factor(row_factor(s, d), "w"), "w", RANK, -0.25, 0.25, 0.0625))
)

# --- updates: one step on each entry alone ------------------------------------------------------

_EPS = 0.0078125
_U = """SELECT e.i, e.j, CAST(wl.k AS INTEGER) AS k, {w} AS w, {h} AS h FROM e JOIN wl ON wl.i = e.i JOIN hl ON hl.j = e.j AND hl.k = wl.k
    JOIN n1 ON n1.i = e.i JOIN n2 ON n2.j = e.j {more}"""


def stepped(update, digits=None, plus=0):
    def run(s, d):
        out = U.step_entries(update, *problem_parts(s, d, plus=plus), RANK, _EPS)
        out = out.select("i", "j", F.posexplode(F.arrays_zip("w", "h")).alias("k", "z")).select("i", "j", "k", F.col("z.w").alias("w"), F.col("z.h").alias("h"))
        return rounded(out, "w", "h", digits=digits) if digits else out

    return run


def _sql_step(w, h, base=BASE, digits=None, more=""):
    r = (lambda x: f"round({x}, {digits})") if digits else (lambda x: x)
    return base + _U.format(w=r(w), h=r(h), more=more)


_GR = f"2 * {_EPS} * (x - dot)"
query("update_none", _sql_step("w", "h"))(stepped(U.none()))
query("update_nzsl", _sql_step(f"w + {_GR} * h", f"h + {_GR} * w"))(stepped(U.squared()))
query("update_nzsl_l2", _sql_step(f"w + {_GR} * h - (2 * {_EPS} * 0.5 / n1.n) * w", f"h + {_GR} * w - (2 * {_EPS} * 0.5 / n2.n) * h"))(stepped(U.squared_l2(0.5)))
query("update_nzsl_nzl2", _sql_step(f"w + {_GR} * h - 2 * {_EPS} * 0.5 * w", f"h + {_GR} * w - 2 * {_EPS} * 0.5 * h"))(stepped(U.squared_nzl2(0.5)))


def _soft(old, g, a):
    return f"CASE WHEN {old} > 0 THEN {old} + {g} - {a} WHEN {old} < 0 THEN {old} + {g} + {a} WHEN {g} > {a} THEN {g} - {a} WHEN {g} < -{a} THEN {g} + {a} ELSE 0 END"


query("update_nzsl_l1", _sql_step(_soft("w", f"{_GR} * h", f"({_EPS} * 64 / n1.n)"), _soft("h", f"{_GR} * w", f"({_EPS} * 64 / n2.n)")))(stepped(U.squared_l1(64.0)))
_GB = f"2 * {_EPS} * (x - b.w0 - b.h0 - b.dot)"
_BJ = """JOIN (SELECT e.i, e.j, e.dot - p.w * q.h AS dot, p.w AS w0, q.h AS h0 FROM e JOIN wl p ON p.i = e.i AND p.k = 0 JOIN hl q ON q.j = e.j AND q.k = 0) b ON b.i = e.i AND b.j = e.j"""
query("update_biased", _sql_step(
    f"CASE WHEN wl.k = 0 THEN w + {_GB} - 2 * {_EPS} * 0.125 * w ELSE w + {_GB} * h - 2 * {_EPS} * 0.5 * w END",
    f"CASE WHEN wl.k = 0 THEN h + {_GB} - 2 * {_EPS} * 0.0625 * h ELSE h + {_GB} * w - 2 * {_EPS} * 0.25 * h END", more=_BJ,
))(stepped(U.biased(0.5, 0.25, 0.125, 0.0625)))
query("update_sl", _sql_step(f"w + 2 * {_EPS} * x * h", f"h + 2 * {_EPS} * x * w"))(stepped(U.full_squared()))
query("update_gkl", _sql_step(f"w + {_EPS} * (x / dot) * h", f"h + {_EPS} * (x / dot) * w", POSITIVE, 9))(stepped(U.gkl(), 9, plus=1))
query("update_abs", _sql_step(f"abs(w + {_GR} * h)", f"abs(h + {_GR} * w)"))(stepped(U.with_abs(U.squared())))


def _cut(x):
    return f"CASE WHEN {x} <= 0.25 THEN 0.25 + 1e-8 WHEN {x} >= 0.5 THEN 0.5 - 1e-8 ELSE {x} END"


query("update_truncate", _sql_step(_cut(f"w + {_GR} * h"), _cut(f"h + {_GR} * w"), digits=9))(stepped(U.with_truncate(U.squared(), 0.25, 0.5), 9))
_MN = f"""SELECT i, j, k, CASE WHEN sum(w * w) OVER p > 2 THEN w / 2 ELSE w END AS w, CASE WHEN sum(h * h) OVER p > 2 THEN h / 2 ELSE h END AS h
    FROM ({_U.format(w=f'w + {_GR} * h', h=f'h + {_GR} * w', more='')}) WINDOW p AS (PARTITION BY i, j)"""
query("update_maxnorm", BASE + _MN)(stepped(U.with_max_norm(U.squared(), 2.0)))

# --- regularizers -------------------------------------------------------------------------------


def regularized(r, digits=None, base=lambda s, d: problem_parts(s, d)):
    def run(s, d):
        v, w, h = base(s, d)
        w, h = r.apply(v, w, h, RANK, _EPS)
        out = long(w, "i", "w").select(F.lit("w").alias("side"), F.col("i").alias("index"), "k", "value").union(long(h, "j", "h").select(F.lit("h"), "j", "k", "value"))
        return rounded(out, "value", digits=digits) if digits else out

    return run


def signed_parts(s, d):
    v, w, h = problem_parts(s, d)
    return v, signed_factor(w, "w"), signed_factor(h, "h")


def _sides(w, h, base=BASE, jw="", jh="", digits=None):
    r = (lambda x: f"round({x}, {digits})") if digits else (lambda x: x)
    return base + f"SELECT 'w' AS side, wl.i AS index, CAST(wl.k AS INTEGER) AS k, {r(w)} AS value FROM wl {jw} UNION ALL SELECT 'h', hl.j, CAST(hl.k AS INTEGER), {r(h)} FROM hl {jh}"


_SIGNED = f"WITH {V}, {wl(shift='- 0.5')}, {hl(shift='- 0.5')} "
query("regularize_none", _sides("w", "h"))(regularized(R.none()))
query("regularize_l1", _sides(f"CASE WHEN w >= 0 THEN w - {_EPS} * 0.5 ELSE w + {_EPS} * 0.5 END", f"CASE WHEN h >= 0 THEN h - {_EPS} * 0.25 ELSE h + {_EPS} * 0.25 END", _SIGNED))(
    regularized(R.l1(0.5, 0.25), base=signed_parts)
)
query("regularize_l2", _sides(f"w * (1 - 2 * {_EPS} * 0.5)", f"h * (1 - 2 * {_EPS} * 0.5)"))(regularized(R.l2(0.5)))
query("regularize_l2_large", _sides("w * (0.25 / (1.5625))", "h * (0.25 / (1.5625))", digits=9))(regularized(R.l2(100.0), 9))
_M = "(SELECT max(n) FROM (SELECT n FROM n1 UNION ALL SELECT n FROM n2))"
_EP = f"(CASE WHEN 1 - 2 * {_EPS} * 0.5 * {_M} < 0.5 THEN (1 / (2 * 0.5 * {_M})) * (1 - 0.25 / (2 * {_EPS} * 0.5 * {_M})) ELSE {_EPS} END)"
query("regularize_nzl2", _sides(f"w * (1 - 2 * {_EP} * 0.5 * coalesce(n1.n, 0))", f"h * (1 - 2 * {_EP} * 0.5 * coalesce(n2.n, 0))", jw="LEFT JOIN n1 ON n1.i = wl.i", jh="LEFT JOIN n2 ON n2.j = hl.j", digits=9))(
    regularized(R.nzl2(0.5), 9)
)
query("regularize_sl", _G.rstrip() + f""", nw AS (SELECT wl.i, gh.b AS k, sum(wl.w * gh.g) AS m FROM wl JOIN gh ON gh.a = wl.k GROUP BY 1, 2), nh AS (SELECT hl.j, gw.b AS k, sum(hl.h * gw.g) AS m FROM hl JOIN gw ON gw.a = hl.k GROUP BY 1, 2)
    SELECT 'w' AS side, i AS index, CAST(k AS INTEGER) AS k, w - 2 * {_EPS} * m AS value FROM wl JOIN nw USING (i, k) UNION ALL SELECT 'h', j, CAST(k AS INTEGER), h - 2 * {_EPS} * m FROM hl JOIN nh USING (j, k)""")(
    regularized(R.full_squared())
)
query("regularize_gkl", f"""WITH {wl()}, {hl()}, sw AS (SELECT k, sum(w) AS t FROM wl GROUP BY 1), sh AS (SELECT k, sum(h) AS t FROM hl GROUP BY 1)
    SELECT 'w' AS side, i AS index, CAST(k AS INTEGER) AS k, w - {_EPS} * t AS value FROM wl JOIN sh USING (k) UNION ALL SELECT 'h', j, CAST(k AS INTEGER), h - {_EPS} * t FROM hl JOIN sw USING (k)""")(
    regularized(R.gkl())
)
query("regularize_abs", _sides(f"abs(CASE WHEN w >= 0 THEN w - {_EPS} * 0.5 ELSE w + {_EPS} * 0.5 END)", f"abs(CASE WHEN h >= 0 THEN h - {_EPS} * 0.5 ELSE h + {_EPS} * 0.5 END)", _SIGNED))(
    regularized(R.with_abs(R.l1(0.5)), base=signed_parts)
)
query("regularize_truncate", _sides(_cut(f"w * (1 - 2 * {_EPS} * 0.5)"), _cut(f"h * (1 - 2 * {_EPS} * 0.5)"), digits=9))(regularized(R.with_truncate(R.l2(0.5), 0.25, 0.5), 9))
query("regularize_maxnorm", BASE + """SELECT 'w' AS side, i AS index, CAST(k AS INTEGER) AS k, CASE WHEN sum(w * w) OVER (PARTITION BY i) > 1 THEN w / 1 ELSE w END AS value FROM wl
    UNION ALL SELECT 'h', j, CAST(k AS INTEGER), CASE WHEN sum(h * h) OVER (PARTITION BY j) > 1 THEN h / 1 ELSE h END FROM hl""")(regularized(R.with_max_norm(R.none(), 1.0)))

# --- balancing ----------------------------------------------------------------------------------


def balanced(kind, method):
    def run(s, d):
        v, w, h = problem_parts(s, d)
        w, h = B.balanced(v, w, h, RANK, kind, method)
        out = long(w, "i", "w").select(F.lit("w").alias("side"), F.col("i").alias("index"), "k", "value").union(long(h, "j", "h").select(F.lit("h"), "j", "k", "value"))
        return rounded(out, "value", digits=9)

    return run


_PEN = {
    "L2": "pw AS (SELECT k, sum(w * w) AS p FROM wl GROUP BY 1), ph AS (SELECT k, sum(h * h) AS p FROM hl GROUP BY 1)",
    "NZL2": "pw AS (SELECT k, sum(n * w * w) AS p FROM wl JOIN n1 USING (i) GROUP BY 1), ph AS (SELECT k, sum(n * h * h) AS p FROM hl JOIN n2 USING (j) GROUP BY 1)",
}
_C = {
    "simple": "c AS (SELECT k, ((SELECT sum(p) FROM ph) / (SELECT sum(p) FROM pw)) ** 0.25 AS c FROM pw)",
    "optimal": "c AS (SELECT k, (ph.p / pw.p) ** 0.25 AS c FROM pw JOIN ph USING (k))",
}
for _kind in _PEN:
    for _method in _C:
        query(f"balance_{_method}_{_kind.lower()}", _sides("wl.w * c.c", "hl.h / c.c", BASE.rstrip() + f", {_PEN[_kind]}, {_C[_method]} ", "JOIN c ON c.k = wl.k", "JOIN c ON c.k = hl.k", 9))(balanced(_kind, _method))

# --- decay, schedules ---------------------------------------------------------------------------


def _trace(s, d):
    per = table(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("loss"))
    base = F.lit("2024-01-01").cast("date")
    return per.select(F.datediff("day", base).alias("epoch"), F.col("loss").cast("double").alias("loss"))


_T = "t AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS epoch, CAST(count(*) AS DOUBLE) AS loss FROM events GROUP BY 1)"
query("bold_driver_trace", f"""WITH {_T}, q AS (SELECT *, lag(loss) OVER (ORDER BY epoch) AS p FROM t)
    SELECT epoch, loss, round(0.01 * 0.5 ** coalesce(sum(CASE WHEN p <= loss THEN 1 ELSE 0 END) OVER o, 0) * 1.05 ** coalesce(sum(CASE WHEN p > loss THEN 1 ELSE 0 END) OVER o, 0), 12) AS eps FROM q WINDOW o AS (ORDER BY epoch)""")(
    lambda s, d: rounded(D.bold_driver_steps(_trace(s, d), 0.01), "eps", digits=12)
)
query("sequential_decay", f"WITH {_T} SELECT epoch, round(0.5 * 3 ** 0.75 / (epoch + 3) ** 0.75, 9) AS eps FROM t")(lambda s, d: rounded(D.sequential_steps(_trace(s, d), 0.5, 0.75, 2.0), "eps", digits=9))
query("schedule_seq", f"WITH {V} SELECT (j + 7 - i % 7) % 7 AS sub_epoch, i % 7 AS b1, j % 7 AS b2, count(*) AS entries FROM v GROUP BY 1, 2, 3")(
    lambda s, d: sequential(s, 7).join(matrix(s, d).groupBy((F.col("i") % 7).alias("b1"), (F.col("j") % 7).alias("b2")).agg(F.count("*").alias("entries")), ["b1", "b2"]).select("sub_epoch", "b1", "b2", "entries")
)

# --- alternating steps --------------------------------------------------------------------------

_R2 = f"WITH {V}, {wl(2, 1)}, {hl(2, 1)}, "
_NORMAL = """n AS (SELECT v.i, sum(p.h * p.h) + {lam} AS a, sum(p.h * q.h) AS b, sum(q.h * q.h) + {lam} AS c, sum(x * p.h) AS y, sum(x * q.h) AS z
    FROM v JOIN hl p ON p.j = v.j AND p.k = 0 JOIN hl q ON q.j = v.j AND q.k = 1 GROUP BY 1)"""
_SOLVED = """SELECT wl.i, CAST(wl.k AS INTEGER) AS k, round(coalesce(CASE WHEN wl.k = 0 THEN (n.y * n.c - n.z * n.b) / (n.a * n.c - n.b * n.b) ELSE (n.a * n.z - n.b * n.y) / (n.a * n.c - n.b * n.b) END, wl.w), 6) AS value
    FROM wl LEFT JOIN n ON n.i = wl.i"""


def als_r2(lam, weighted):
    def run(s, d):
        v, w, h = problem_parts(s, d, 2, 1)
        return rounded(long(als.half_step(v, h, w, 2, side="w", lam=lam, weighted=weighted), "i", "w"), "value")

    return run


query("als_half_step_r2", _R2 + _NORMAL.format(lam="1.0") + _SOLVED)(als_r2(1.0, False))
query("als_half_step_nzl2_r2", _R2 + _NORMAL.format(lam="0.5 * count(*)") + _SOLVED)(als_r2(0.5, True))
query("als_half_step_h_r2", _R2 + """n AS (SELECT v.j, sum(p.w * p.w) + 1.0 AS a, sum(p.w * q.w) AS b, sum(q.w * q.w) + 1.0 AS c, sum(x * p.w) AS y, sum(x * q.w) AS z FROM v JOIN wl p ON p.i = v.i AND p.k = 0 JOIN wl q ON q.i = v.i AND q.k = 1 GROUP BY 1)
    SELECT hl.j, CAST(hl.k AS INTEGER) AS k, round(coalesce(CASE WHEN hl.k = 0 THEN (n.y * n.c - n.z * n.b) / (n.a * n.c - n.b * n.b) ELSE (n.a * n.z - n.b * n.y) / (n.a * n.c - n.b * n.b) END, hl.h), 6) AS value FROM hl LEFT JOIN n ON n.j = hl.j""")(
    lambda s, d: rounded(long(als.half_step(matrix(s, d), row_factor(s, d, 2, 1), column_factor(s, d, 2, 1), 2, side="h", lam=1.0), "j", "h"), "value")
)
_POSG = f"WITH {V}, {wl(plus=1)}, {hl(plus=1)}, {e_()}, "
query("gnmf_h_step", _POSG + """t AS (SELECT v.j, wl.k, sum(x * w) AS t FROM v JOIN wl ON wl.i = v.i GROUP BY 1, 2), g AS (SELECT p.k AS a, q.k AS b, sum(p.w * q.w) AS g FROM wl p JOIN wl q USING (i) GROUP BY 1, 2),
    l AS (SELECT hl.j, g.a AS k, sum(g.g * hl.h) AS l FROM hl JOIN g ON g.b = hl.k GROUP BY 1, 2)
    SELECT hl.j, CAST(hl.k AS INTEGER) AS k, round(hl.h * coalesce(t.t, 0) / l.l, 6) AS value FROM hl JOIN l ON l.j = hl.j AND l.k = hl.k LEFT JOIN t ON t.j = hl.j AND t.k = hl.k""")(
    lambda s, d: rounded(long(multiplicative.gnmf_step(*problem_parts(s, d, plus=1), RANK, "h"), "j", "h"), "value")
)
query("gnmf_w_step", _POSG + """t AS (SELECT v.i, hl.k, sum(x * h) AS t FROM v JOIN hl ON hl.j = v.j GROUP BY 1, 2), g AS (SELECT p.k AS a, q.k AS b, sum(p.h * q.h) AS g FROM hl p JOIN hl q USING (j) GROUP BY 1, 2),
    l AS (SELECT wl.i, g.a AS k, sum(g.g * wl.w) AS l FROM wl JOIN g ON g.b = wl.k GROUP BY 1, 2)
    SELECT wl.i, CAST(wl.k AS INTEGER) AS k, round(wl.w * coalesce(t.t, 0) / l.l, 6) AS value FROM wl JOIN l ON l.i = wl.i AND l.k = wl.k LEFT JOIN t ON t.i = wl.i AND t.k = wl.k""")(
    lambda s, d: rounded(long(multiplicative.gnmf_step(*problem_parts(s, d, plus=1), RANK, "w"), "i", "w"), "value")
)
query("lee_w_step", _POSG + """t AS (SELECT e.i, hl.k, sum(x / dot * h) AS t FROM e JOIN hl ON hl.j = e.j GROUP BY 1, 2), s AS (SELECT k, sum(h) AS s FROM hl GROUP BY 1)
    SELECT wl.i, CAST(wl.k AS INTEGER) AS k, round(wl.w * coalesce(t.t, 0) / s.s, 6) AS value FROM wl JOIN s ON s.k = wl.k LEFT JOIN t ON t.i = wl.i AND t.k = wl.k""")(
    lambda s, d: rounded(long(multiplicative.kl_step(*problem_parts(s, d, plus=1), RANK, "w"), "i", "w"), "value")
)
query("lee_h_step", _POSG + """t AS (SELECT e.j, wl.k, sum(x / dot * w) AS t FROM e JOIN wl ON wl.i = e.i GROUP BY 1, 2), s AS (SELECT k, sum(w) AS s FROM wl GROUP BY 1)
    SELECT hl.j, CAST(hl.k AS INTEGER) AS k, round(hl.h * coalesce(t.t, 0) / s.s, 6) AS value FROM hl JOIN s ON s.k = hl.k LEFT JOIN t ON t.j = hl.j AND t.k = hl.k""")(
    lambda s, d: rounded(long(multiplicative.kl_step(*problem_parts(s, d, plus=1), RANK, "h"), "j", "h"), "value")
)

# --- analysis -----------------------------------------------------------------------------------

_COS = "list_sum(list_transform(range(1, 65), lambda k: CAST(a.embedding[k] AS DOUBLE) * CAST(b.embedding[k] AS DOUBLE)))"
_NRM = "sqrt(list_sum(list_transform(range(1, 65), lambda k: CAST({t}.embedding[k] AS DOUBLE) ** 2)))"


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("g"), F.col("embedding").cast("array<double>").alias("v"))


query("top_similar", f"SELECT b.vec_id AS id, round({_COS} / ({_NRM.format(t='a')} * {_NRM.format(t='b')}), 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id = 7 ORDER BY {_COS} / ({_NRM.format(t='a')} * {_NRM.format(t='b')}) DESC, b.vec_id LIMIT 20")(
    lambda s, d: rounded(N.similar(_vectors(s, d), "id", "v", 64, 7, 20), "similarity")
)
query("top_predictions", f"WITH {wl()}, {hl()} SELECT i, sum(w * h) AS prediction FROM wl JOIN hl USING (k) WHERE j = 17 GROUP BY i ORDER BY prediction DESC, i LIMIT 20")(
    lambda s, d: N.predictions(row_factor(s, d), column_factor(s, d), RANK, 17, 20)
)
query("cos_dist", f"SELECT a.vec_id AS a, b.vec_id AS b, round(1 - {_COS} / ({_NRM.format(t='a')} * {_NRM.format(t='b')}), 6) AS distance FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 50 = 0")(
    lambda s, d: rounded(N.cosine_distances(_vectors(s, d).filter("id % 50 = 0"), _vectors(s, d), 64), "distance")
)
query("event_stats", "SELECT event_type, count(*) AS n, min(value) AS low, round(avg(value), 6) AS mean, max(value) AS high, round(stddev_samp(value) / avg(value), 6) AS cv FROM events GROUP BY 1")(
    lambda s, d: rounded(N.event_stats(table(s, d, "events"), "event_type", "value"), "mean", "cv")
)


def _signed(s, d):
    """Events as starts and ends: within a user they alternate in groups of two, which nests sections two deep."""
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(s, d, "events").withColumn("type", F.when((n - 1) % 4 < 2, "+").otherwise("-"))


_SE = "p AS (SELECT *, CASE WHEN (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 4 < 2 THEN '+' ELSE '-' END AS type FROM events)"
_SEC = f"""WITH {_SE}, q AS (SELECT *, sum(CASE type WHEN '+' THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY event_id) + CASE type WHEN '+' THEN 0 ELSE 1 END AS depth FROM p),
    r AS (SELECT *, lead(event_id) OVER z AS stop, lead(type) OVER z AS ended, lead(event_type) OVER z AS closing FROM q WINDOW z AS (PARTITION BY user_id, depth ORDER BY event_id)),
    sec AS (SELECT user_id, CAST(depth AS BIGINT) AS depth, event_type, event_id AS start, CASE WHEN ended = '-' THEN stop END AS stop, CASE WHEN ended = '-' THEN closing = event_type END AS matched FROM r WHERE type = '+') """


def _sections(s, d):
    return N.sections(_signed(s, d), ["user_id"], "event_id", "type", "event_type")


query("sections", _SEC + "SELECT * FROM sec")(_sections)
query("section_spans", _SEC + "SELECT user_id, min(start) AS start, max(stop) AS stop, max(depth) AS depth FROM sec GROUP BY 1")(lambda s, d: N.spans(_sections(s, d), ["user_id"]))
query("cum_offset", "SELECT event_id, user_id, event_type, round(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS \"offset\" FROM events")(
    lambda s, d: rounded(N.offsets(table(s, d, "events"), "event_id", "value", ["user_id"]).select("event_id", "user_id", "event_type", "offset"), "offset", digits=4)
)
query("stream_totals_batch", f"WITH {V} SELECT i, count(*) AS nnz, sum(x) AS total, sum(x * x) AS squares FROM v GROUP BY 1")(lambda s, d: E.running_totals(matrix(s, d)))
query("windowed_counts_batch", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")(
    lambda s, d: rounded(E.windowed_counts(table(s, d, "events"), "ts", "event_type", "value"), "mean")
)
query("predict_entries", BASE + "SELECT i, j, x, dot AS prediction, x - dot AS error FROM e")(lambda s, d: E.predicted(*problem_parts(s, d), RANK))
query("event_slots")(lambda s, d: N.slots(_sections(s, d).filter("stop is not null").select(F.col("user_id").alias("rank"), F.col("start").alias("task"), F.col("start").cast("double").alias("start"), F.col("stop").cast("double").alias("stop"))))

# --- sources and sinks: what is written is what is read ------------------------------------------


def _path(s, name: str) -> str:
    t = Tables(s)
    return f"{t.path}/{name}"


@query("io_coordinate", f"WITH {V} SELECT i, j, x FROM v")
def io_coordinate(s, d):
    path = _path(s, "m.mmc")
    M.write_matrix(matrix(s, d), MatrixMeta(100_000, 100_000), path)
    return M.read_matrix(s, path)[0]


_DENSE = f"WITH {V} SELECT a.range AS i, b.range AS j, coalesce(x, 0) AS x FROM range((SELECT max(s_suppkey) + 1 FROM supplier)) a CROSS JOIN range((SELECT max(p_partkey) + 1 FROM part)) b LEFT JOIN v ON v.i = a.range AND v.j = b.range"


@query("io_array", _DENSE)
def io_array(s, d):
    """The whole matrix in dense form."""
    path = _path(s, "m.mma")
    M.write_matrix(matrix(s, d), sizes(s, d), path)
    return M.read_matrix(s, path)[0]


@query("io_array_parts", _DENSE)
def io_array_parts(s, d):
    """The same from parts of unequal sizes, each larger than the one before it."""
    two = _path(s, "parts.mma")
    M.write_array(matrix(s, d), sizes(s, d), two, ends=tuple((k / 5) ** 4 for k in (1, 2, 3, 4, 5)))  # most lines come last
    return M.read_matrix(s, two)[0]


@query("io_factor_rows", f"WITH {wl()} SELECT a.range AS i, CAST(b.range AS INTEGER) AS k, coalesce(w, 0) AS value FROM range((SELECT max(s_suppkey) + 1 FROM supplier)) a CROSS JOIN range({RANK}) b LEFT JOIN wl ON wl.i = a.range AND wl.k = b.range")
def io_factor_rows(s, d):
    path = _path(s, "w.mma")
    M.write_matrix(long(row_factor(s, d), "i", "w").select("i", F.col("k").cast("long").alias("j"), F.col("value").alias("x")), MatrixMeta(sizes(s, d).size1, RANK), path)
    return long(M.read_factor(s, path, "w"), "i", "w")


@query("io_factor_columns", f"WITH {hl()} SELECT a.range AS j, CAST(b.range AS INTEGER) AS k, coalesce(h, 0) AS value FROM range((SELECT max(p_partkey) + 1 FROM part)) a CROSS JOIN range({RANK}) b LEFT JOIN hl ON hl.j = a.range AND hl.k = b.range")
def io_factor_columns(s, d):
    path = _path(s, "h.mma")
    M.write_matrix(long(column_factor(s, d), "j", "h").select(F.col("k").cast("long").alias("i"), "j", F.col("value").alias("x")), MatrixMeta(RANK, sizes(s, d).size2), path)
    return long(M.read_factor(s, path, "h"), "j", "h")


@query("io_csv_to_parquet", f"WITH {V} SELECT i, j, x FROM v")
def io_csv_to_parquet(s, d):
    one, two = _path(s, "m.csv"), _path(s, "m.parquet")
    M.write_matrix(matrix(s, d), MatrixMeta(0, 0), one)
    M.convert(s, one, two)
    return M.read_matrix(s, two)[0]


@query("io_blocked", f"WITH {V} SELECT i, j, x FROM v WHERE i // 1429 = 0 AND j < 14286")
def io_blocked(s, d):
    """Blocks (0, 0) of 7 x 7; the others' files are not opened."""
    path = _path(s, "blocked")
    K.write_blocked(matrix(s, d), MatrixMeta(10_003, 99_997), 7, 7, path)
    return K.read_blocked(s, path, [0], [0])[0]


@query("io_projected", f"WITH {_OP}, {_FREQ.format(t=4)} SELECT r.old AS i, c.old AS j, x FROM v JOIN r ON r.old = v.i JOIN c ON c.old = v.j")
def io_projected(s, d):
    """A projection written and read again, led back to its original indexes by its maps."""
    path = _path(s, "projected")
    K.write_projected(P.frequent(order_matrix(s, d), 4), path)
    p = K.read_projected(s, path)
    back = p.data.join(p.map1.select(F.col("new").alias("i"), F.col("old").alias("oi")), "i").join(p.map2.select(F.col("new").alias("j"), F.col("old").alias("oj")), "j")
    return back.select(F.col("oi").alias("i"), F.col("oj").alias("j"), "x")


@query("io_map", f"WITH {_OP}, {_FREQ.format(t=4)} SELECT new, old FROM r")
def io_map(s, d):
    path = _path(s, "rows.mfm")
    K.write_map(P.frequent(order_matrix(s, d), 4).map1, 1_000_000, path)
    return K.read_map(s, path)


@query("parse_event_log", "SELECT CAST(event_id AS DOUBLE) AS elapsed, 'host' AS host, CAST(user_id AS INTEGER) AS rank, CAST(event_id % 7 AS INTEGER) AS task, value AS time, CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS type, event_type AS event FROM events")
def parse_event_log(s, d):
    e = table(s, d, "events")
    line = F.concat_ws(" ", F.col("event_id").cast("string"), F.lit("host"), "user_id", (F.col("event_id") % 7).cast("string"), F.col("value").cast("string"), F.when(F.col("event_id") % 2 == 0, "+").otherwise("-"), "event_type")
    return N.parse_events(e.select(line.alias("value")).union(s.createDataFrame([("no event",), ("",)], "value string")))


@query("generate_counts", f"WITH {V} SELECT count(*) AS n, count(*) AS cells, TRUE AS inside FROM v")
def generate_counts(s, d):
    """As many cells as the matrix has, drawn at random from its range."""
    m = sizes(s, d)
    v = G.sparse(s, G.RandomMatrix(m.size1, m.size2, matrix(s, d).count()))
    return v.agg(F.count("*").alias("n"), F.countDistinct("i", "j").alias("cells"), ((F.max(F.col("i")) < m.size1) & (F.max(F.col("j")) < m.size2)).alias("inside"))


query("permutation_is_one_to_one", "SELECT count(*) AS n, CAST(sum(i) AS BIGINT) AS total, max(i) AS top FROM (SELECT unnest(range(max(l_partkey) + 1)) AS i FROM lineitem)")(
    lambda s, d: P.permutation(sizes(s, d).size2, s, 2).agg(F.countDistinct("new").alias("n"), F.sum("new").alias("total"), F.max("new").alias("top"))
)
query("from_factors", f"WITH {V}, {wl()}, {hl()}, {e_()} SELECT i, j, dot AS x FROM e")(lambda s, d: G.from_factors(matrix(s, d).select("i", "j"), row_factor(s, d), column_factor(s, d), RANK))

# --- fits and generators: no SQL ----------------------------------------------------------------


def dense_problem(s, d, r=RANK) -> Problem:
    """The matrix with values near 1, factors between 0 and 1."""
    v, w, h = matrix(s, d), row_factor(s, d, r, 1), column_factor(s, d, r, 1)
    size = (w.agg(F.max("i")).first()[0] + 1, h.agg(F.max("j")).first()[0] + 1)
    return Problem(v.withColumn("x", F.col("x") / 25), w, h, MatrixMeta(*size), r)


def fitted(**spec):
    def run(s, d):
        got = factorize(dense_problem(s, d), Spec(**spec)).trace
        return got.select("epoch", F.round("loss", 3).alias("loss"))

    return run


query("als_fit")(fitted(method="als", loss="Nzsl_L2(1)", epochs=4))
query("gnmf_fit")(fitted(method="gnmf", loss="Sl", epochs=4))
query("lee_fit")(fitted(method="lee", loss="Gkl", epochs=4))
query("sgd_fit")(fitted(method="sgd", update="Nzsl_Nzl2(0.01)", loss="Nzsl_Nzl2(0.01)", decay="BoldDriver(0.005)", epochs=2))
query("dsgd_fit")(fitted(method="dsgd", update="Nzsl_L2(1)", loss="Nzsl_L2(1)", decay="BoldDriver(0.005)", epochs=2, blocks=4, group=2))
query("overlapped_fit")(fitted(method="overlapped", update="Nzsl", loss="Nzsl", decay="Const(0.005)", epochs=1, blocks=3))
query("asgd_fit")(fitted(method="asgd", update="Nzsl", loss="Nzsl", decay="Const(0.002)", epochs=2, blocks=4, average=True))
query("csgd_fit")(fitted(method="csgd", update="Nzsl", regularize="L2(0.1)", loss="Nzsl_L2(0.1)", decay="Sequential(0.005,0.5)", epochs=2, blocks=4))
query("auto_decay_fit")(fitted(method="dsgd", update="Nzsl", loss="Nzsl", decay="Auto(0.01,5)", epochs=2, blocks=2))
query("generate_sparse")(lambda s, d: G.sparse(s, _properties._like_matrix(s, d)))
query("generate_problem")(lambda s, d: G.problem(s, _properties._like_matrix(s, d, nnz_test=400, rank=5))[0].v)
query("generate_poisson")(lambda s, d: P.poisson(G.sparse(s, _properties._like_matrix(s, d), "Uniform(0,5)"), 3))
query("random_submatrix")(lambda s, d: P.random_submatrix(matrix(s, d), sizes(s, d), 5, 100).data)
query("shuffle_rows")(lambda s, d: P.permuted(row_factor(s, d), "i", P.permutation(sizes(s, d).size1, s, 2)))


from . import properties as _properties  # noqa: E402, F401  registers its queries


def flagship(s: SparkSession, d: str) -> DataFrame:
    """One alternating least squares half step on the supplier x part matrix."""
    v, w, h = problem_parts(s, d, plus=1)
    return als.half_step(v, h, w, RANK, lam=1.0)
