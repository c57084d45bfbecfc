"""Matrices and problems by file name: loaded, or generated where the name is that of a description."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import MatrixMeta, Problem
from . import blocked as K
from . import generate as G
from . import matrix_market as M


def write_random(spark: SparkSession, m: G.RandomMatrix, path: str) -> None:
    """A ``.rm`` file: the description of a random problem, from which every reader gets the same values."""
    K._put(spark, path, m.to_json())


def read_random(spark: SparkSession, path: str) -> G.RandomMatrix:
    return G.RandomMatrix.from_json(K._get(spark, path))


def open_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, MatrixMeta]:
    """V(i, j, x) and its sizes of a file of any kind: matrices, ``.mfp`` projections, ``.xml`` blocked matrices and ``.rm`` descriptions (their training data)."""
    fmt = M.format_of(path)
    if fmt == "random":
        m = read_random(spark, path)
        return G.problem(spark, m)[0].v, MatrixMeta(m.size1, m.size2)
    if fmt == "projected":
        p = K.read_projected(spark, path)
        return p.data, p.meta
    return K.read_blocked(spark, path) if fmt == "blocked" else M.read_matrix(spark, path)


def open_factors(spark: SparkSession, rows: str, columns: str) -> tuple[DataFrame, DataFrame]:
    """W(i, w) and H(j, h): array files, Parquet tables, or the planted factors of a ``.rm`` description."""

    def read(path: str, side: str) -> DataFrame:
        if path.endswith(".rm"):
            return G.problem(spark, read_random(spark, path))[1 if side == "w" else 2]
        return M.read_factor(spark, path, side) if path.endswith(".mma") else spark.read.parquet(path)

    return read(rows, "w"), read(columns, "h")


def open_problem(spark: SparkSession, train: str, test: str | None = None, rows: str | None = None, columns: str | None = None, *, rank: int | None = None, initial: str = "Uniform(-0.5,0.5)", seed: int = 1) -> Problem:
    """A problem from files, or wholly from a ``.rm`` description; starting factors that are not given are drawn from ``initial``."""
    if M.format_of(train) == "random":
        got = G.problem(spark, read_random(spark, train), initial)[0]
        v, held, w, h, meta, rank = got.v, got.test, got.w, got.h, got.meta, got.rank
    else:
        (v, meta), held = open_matrix(spark, train), open_matrix(spark, test)[0] if test else None
        w = h = None
    if rows and columns:
        w, h = open_factors(spark, rows, columns)
        rank = w.select(F.size("w")).first()[0]
    elif w is None:
        if rank is None:
            raise ValueError("starting factors or a rank")
        w, h = G.factor(spark, meta.size1, rank, initial, seed), G.factor(spark, meta.size2, rank, initial, seed + 1, "j", "h")
    return Problem(v, w, h, meta, rank, held)
