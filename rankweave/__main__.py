"""Command line: ``python -m rankweave <tool> ...``; matrices are files of any kind that :mod:`sources.described` opens."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .operators import reshape as P
from .operators.analysis import trace_lines
from .plans.factorize import METHODS, Spec, factorize
from .plans.store import Tables
from .sources import blocked as K
from .sources import described
from .sources import generate as G
from .sources import matrix_market as M


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rankweave", description=__doc__)
    tools = top.add_subparsers(dest="tool", required=True)

    def tool(name: str, text: str, *paths: str) -> argparse.ArgumentParser:
        p = tools.add_parser(name, help=text)
        for x in paths:
            p.add_argument(x)
        return p

    p = tool("factorize", "factors of a matrix, and the trace of the fit; - as rows and columns draws the starting factors", "matrix", "rows", "columns", "out")
    p.add_argument("--test")
    p.add_argument("--rank", type=int, default=10)
    p.add_argument("--cache-kb", type=float, default=256)
    p.add_argument("--method", choices=METHODS, default="dsgd")
    for x, default in (("update", "Nzsl"), ("regularize", "None"), ("loss", "Nzsl"), ("decay", "BoldDriver(0.001)"), ("order", "WOR"), ("strata", "COWOR"), ("balance", "None"), ("balance-method", "optimal")):
        p.add_argument(f"--{x}", default=default)
    for x, default in (("epochs", 10), ("blocks", 0), ("batches", 4), ("staleness", -1), ("group", 1), ("seed", 1)):
        p.add_argument(f"--{x}", type=int, default=default)
    p.add_argument("--truncate", type=float, nargs=2)
    p.add_argument("--max-norm", type=float)
    p.add_argument("--abs", action="store_true")
    p.add_argument("--average-deltas", action="store_true")

    p = tool("demo", "a fit with rank 50, penalty 50 and a search of step sizes", "matrix", "out")
    p.add_argument("--rank", type=int, default=50)
    p.add_argument("--epochs", type=int, default=10)
    tool("convert", "one format to another", "source", "target")
    tool("info", "sizes and form of a MatrixMarket file", "matrix")
    p = tool("center", "subtract the mean of the training entries", "train", "out")
    p.add_argument("--test")
    p.add_argument("--test-out")
    p = tool("project", "rows and columns with more than a number of entries", "matrix", "out")
    p.add_argument("--threshold", type=int, default=0)
    p.add_argument("--repeat", action="store_true", help="until nothing goes")
    p = tool("sample", "a random submatrix", "matrix", "out")
    p.add_argument("--size", type=int)
    p.add_argument("--fraction", type=float)
    p.add_argument("--nnz", type=int)
    p.add_argument("--threshold", type=int)
    p.add_argument("--seed", type=int, default=1)
    p = tool("prepare", "a sample, its frequent rows and columns, and starting factors for them", "matrix", "out")
    for x in ("size", "nnz"):
        p.add_argument(f"--{x}", type=int)
    p.add_argument("--fraction", type=float)
    for x, default in (("threshold", 0), ("rank", 10), ("seed", 1)):
        p.add_argument(f"--{x}", type=int, default=default)
    p.add_argument("--values", default="Uniform(-0.5,0.5)")
    p = tool("block", "entries in folders by block", "matrix", "out")
    p.add_argument("--blocks1", type=int, required=True)
    p.add_argument("--blocks2", type=int, required=True)
    p = tool("apply", "values replaced by an SQL expression of i, j and x", "matrix", "expression", "out")
    p = tool("factors", "random starting factors", "out")
    for x in ("size1", "size2"):
        p.add_argument(f"--{x}", type=int, required=True)
    p.add_argument("--rank", type=int, default=10)
    p.add_argument("--values", default="Uniform(-0.5,0.5)")
    p.add_argument("--seed", type=int, default=1)
    for name, text in (("generate", "a random problem with planted factors"), ("describe", "a .rm file from which readers generate that problem")):
        p = tool(name, text, "out")
        for x, default in (("size1", None), ("size2", None), ("nnz", None), ("nnz-test", 0), ("rank", 10), ("seed", 123), ("chunks", 8)):
            p.add_argument(f"--{x}", type=int, required=default is None, default=default)
        p.add_argument("--values", default="Normal(0,1)")
        p.add_argument("--noise", default="Normal(0,0.1)")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("rankweave").getOrCreate()
    read = lambda path: described.open_matrix(spark, path)
    if a.tool in ("factorize", "demo"):
        if a.tool == "demo":
            spec = Spec(method="sgd", update="Nzsl_L2(50)", loss="Nzsl_L2(50)", decay="Auto(0.01,7)", epochs=a.epochs)
            problem = described.open_problem(spark, a.matrix, rank=a.rank)
        else:
            spec = Spec(a.method, a.update, a.regularize, a.loss, a.decay, a.epochs, a.blocks, a.order, a.strata, a.group, a.balance, a.balance_method, a.abs, tuple(a.truncate) if a.truncate else None, a.max_norm, a.average_deltas, a.seed, a.cache_kb, a.batches, a.staleness)
            rows, columns = (None if x == "-" else x for x in (a.rows, a.columns))
            problem = described.open_problem(spark, a.matrix, a.test, rows, columns, rank=a.rank, seed=a.seed)
        got = factorize(problem, spec)
        for name in ("w", "h", "trace"):
            getattr(got, name).write.parquet(f"{a.out}/{name}")
        trace_lines(got.trace).orderBy("epoch").select("line").coalesce(1).write.text(f"{a.out}/trace.R")
    elif a.tool == "info":
        print(json.dumps(M.matrix_info(spark, a.matrix)))
    elif a.tool == "prepare":
        v, meta = read(a.matrix)
        got = G.prepare(v, meta, threshold=a.threshold, seed=a.seed, size=a.size, fraction=a.fraction, target_nnz=a.nnz)
        K.write_projected(got, a.out)
        for side, m, index, k in (("w", got.map1, "i", 0), ("h", got.map2, "j", 1)):
            G.factor(spark, m.count(), a.rank, a.values, a.seed + k, index, side).write.parquet(f"{a.out}/{side}")
    elif a.tool == "describe":
        described.write_random(spark, G.RandomMatrix(a.size1, a.size2, a.nnz, a.nnz_test, a.rank, a.values, a.noise, a.chunks, a.seed), a.out)
    elif a.tool == "convert":
        M.convert(spark, a.source, a.target)
    elif a.tool == "center":
        train, meta = read(a.train)
        M.write_matrix(P.centred(train).select("i", "j", "x"), meta, a.out)
        if a.test:
            test, meta = read(a.test)
            M.write_matrix(P.centred(train, test).select("i", "j", "x"), meta, a.test_out)
    elif a.tool == "project":
        v, _ = read(a.matrix)
        K.write_projected(P.core(v, a.threshold, Tables(spark).put) if a.repeat else P.frequent(v, a.threshold), a.out)
    elif a.tool == "sample":
        v, meta = read(a.matrix)
        n1, n2 = G.sample_sizes(meta, v.count(), size=a.size, fraction=a.fraction, target_nnz=a.nnz)
        got = P.random_submatrix(v, meta, n1, n2, a.seed)
        K.write_projected(got if a.threshold is None else P.frequent(got, a.threshold), a.out)
    elif a.tool == "block":
        v, meta = read(a.matrix)
        K.write_blocked(v, meta, a.blocks1, a.blocks2, a.out)
    elif a.tool == "apply":
        v, meta = read(a.matrix)
        M.write_matrix(P.mapped(v, a.expression), meta, a.out)
    elif a.tool == "factors":
        G.factor(spark, a.size1, a.rank, a.values, a.seed).write.parquet(f"{a.out}/w")
        G.factor(spark, a.size2, a.rank, a.values, a.seed + 1, "j", "h").write.parquet(f"{a.out}/h")
    else:
        m = G.RandomMatrix(a.size1, a.size2, a.nnz, a.nnz_test, a.rank, a.values, a.noise, a.chunks, a.seed)
        p, w, h = G.problem(spark, m)
        for name, df in (("train.parquet", p.v), ("test.parquet", p.test), ("w", p.w), ("h", p.h), ("planted_w", w), ("planted_h", h)):
            if df is not None:
                df.write.parquet(f"{a.out}/{name}")


if __name__ == "__main__":
    main()
