"""Small dense linear algebra inside a group or an Arrow batch, tall-skinny QR and least squares over tables, and the leading singular vectors of a matrix table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import each
from ..session import ship
from . import aggregate as A


def lu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LU with partial pivoting: L below and U on and above the diagonal of one matrix, and the row order."""
    m = np.array(a, float)
    order = np.arange(len(m))
    for k in range(min(m.shape)):
        p = k + int(np.abs(m[k:, k]).argmax())
        if m[p, k] == 0:
            continue
        if p != k:
            m[[k, p]], order[[k, p]] = m[[p, k]], order[[p, k]]
        m[k + 1 :, k] /= m[k, k]
        m[k + 1 :, k + 1 :] -= np.outer(m[k + 1 :, k], m[k, k + 1 :])
    return m, order


def lu_solve(factors: tuple[np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
    """Solve A x = b from :func:`lu`; a singular A raises LinAlgError."""
    m, order = factors
    if (np.diag(m) == 0).any():
        raise np.linalg.LinAlgError("singular matrix")
    y = np.array(b, float)[order]
    for k in range(len(m)):
        y[k] -= m[k, :k] @ y[:k]
    for k in range(len(m) - 1, -1, -1):
        y[k] = (y[k] - m[k, k + 1 :] @ y[k + 1 :]) / m[k, k]
    return y


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.solve(a, b)


def lu_many(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`lu` of a stack of square matrices at once."""
    m = np.array(a, float)
    n, r = m.shape[:2]
    every, order = np.arange(n), np.tile(np.arange(r), (n, 1))
    for k in range(r):
        p = k + np.abs(m[:, k:, k]).argmax(axis=1)
        for x in (m, order):
            x[every, k], x[every, p] = x[every, p].copy(), x[every, k].copy()
        pivot = m[:, k, k]
        m[:, k + 1 :, k] /= np.where(pivot == 0, 1, pivot)[:, None]
        m[:, k + 1 :, k + 1 :] -= m[:, k + 1 :, k, None] * m[:, None, k, k + 1 :]
    return m, order


def lu_solve_many(factors: tuple[np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
    """Solutions of a stack of systems; those of a singular one are not a number."""
    m, order = factors
    r = m.shape[1]
    y = np.take_along_axis(np.array(b, float), order, axis=1)
    for k in range(1, r):
        y[:, k] -= (m[:, k, :k] * y[:, :k]).sum(axis=1)
    for k in range(r - 1, -1, -1):
        pivot = m[:, k, k]
        y[:, k] = (y[:, k] - (m[:, k, k + 1 :] * y[:, k + 1 :]).sum(axis=1)) / np.where(pivot == 0, np.nan, pivot)
    return y


def _stack(column: pa.Array, *shape: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(float).reshape(len(column), *shape)


def _vectors(x: np.ndarray) -> pa.Array:
    flat = x.reshape(len(x), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))


def lu_rows(systems: DataFrame, index: str, matrix: str, rank: int, rhs: str | None = None) -> DataFrame:
    """(index, lu, order) of a table with a square matrix a row, flat in ``matrix``; with ``rhs`` also ``solution`` (null for a singular matrix)."""

    ship(systems.sparkSession)

    def run(batches):
        for batch in batches:
            m, order = lu_many(_stack(batch.column(matrix), rank, rank))
            cols = {index: batch.column(index), "lu": _vectors(m), "order": _vectors(order.astype(np.int32))}
            if rhs:
                x = lu_solve_many((m, order), _stack(batch.column(rhs), rank))
                bad = np.isnan(x).any(axis=1)
                cols["solution"] = pa.array([None if b else r for r, b in zip(x.tolist(), bad)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_pydict(cols)

    kind = systems.schema[index].dataType.simpleString()
    return systems.select(index, matrix, *([rhs] if rhs else [])).mapInArrow(run, f"{index} {kind}, lu array<double>, order array<int>" + (", solution array<double>" if rhs else ""))


def qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """QR with a diagonal of R that is not negative, so that R is one whatever the order of the rows."""
    q, r = np.linalg.qr(a)
    sign = np.where(np.diag(r) < 0, -1.0, 1.0)
    return q * sign, r * sign[:, None]


def tall_qr(df: DataFrame, index: str, vector: str, rank: int, write: Callable[[DataFrame], DataFrame], block_rows: int = 1 << 16, fan: int = 64, with_q: bool = True) -> tuple[DataFrame | None, np.ndarray]:
    """Q (index, vector) and R (rank x rank) of a table of vectors, row by row of any number.

    Blocks of about ``block_rows`` rows are factorized side by side; their triangles are stacked
    ``fan`` at a time and factorized again, up a tree; on the way back every block gets the
    rank x rank matrix that its own Q is to be multiplied with.  Only R reaches the driver.
    """
    ship(df.sparkSession)
    blocks = 1 + df.count() // block_rows
    square = f"b long, {index} {df.schema[index].dataType.simpleString()}, {vector} array<double>, up array<double>"

    def leaf(key, own):
        x = _stack(own.column(vector).combine_chunks(), rank)
        pad = np.vstack([x, np.zeros((max(0, rank - len(x)), rank))])  # fewer rows than columns
        q, r = qr(pad)
        none = pa.nulls(1, own.schema.field(index).type)
        up = pa.table([pa.array([key[0].as_py()]), none, pa.nulls(1, pa.list_(pa.float64())), _vectors(r[None])], names=["b", index, vector, "up"])
        rows = pa.table([pa.array(np.full(len(x), key[0].as_py())), own.column(index), _vectors(q[: len(x)]), pa.nulls(len(x), pa.list_(pa.float64()))], names=["b", index, vector, "up"])
        return pa.concat_tables([up, rows] if with_q else [up])

    done = write(df.select(index, vector, F.pmod(F.xxhash64(index), F.lit(blocks)).alias("b")).groupBy("b").applyInArrow(leaf, square))
    levels, left = [], done.filter("up is not null").select("b", "up")

    def merge(key, own):
        own = own.sort_by("b")
        q, r = qr(np.vstack([*_stack(own.column("up").combine_chunks(), rank, rank), np.zeros((rank, rank))]))
        parts = q[: own.num_rows * rank].reshape(own.num_rows, rank, rank)
        return pa.table([own.column("b"), pa.array(np.full(own.num_rows, key[0].as_py())), _vectors(parts), _vectors(np.tile(r, (own.num_rows, 1, 1)))], names=["b", "to", "part", "up"])

    while True:
        level = write(left.withColumn("to", F.floor(F.col("b") / fan)).groupBy("to").applyInArrow(merge, "b long, to long, part array<double>, up array<double>"))
        levels.append(level.select("b", "to", "part"))
        left = level.groupBy(F.col("to").alias("b")).agg(F.any_value("up").alias("up"))
        blocks = -(-blocks // fan)
        if blocks == 1:
            break
    top = left.head()
    r = np.array(top.up).reshape(rank, rank) if top else np.zeros((rank, rank))
    if not with_q:
        return None, r
    down = levels[-1].select("b", F.col("part").alias("m"))
    cell = lambda a, b: sum((F.col("part")[a * rank + k] * F.col("m")[k * rank + b] for k in range(rank)), F.lit(0.0))
    for level in levels[-2::-1]:
        down = level.join(down.withColumnRenamed("b", "to"), "to").select("b", F.array(*(cell(a, b) for a in range(rank) for b in range(rank))).alias("m"))
    q = done.filter("up is null").join(down, "b")
    return q.select(index, each(rank, lambda k: sum((F.col(vector)[a] * F.col("m")[a * rank + k] for a in range(rank)), F.lit(0.0))).alias(vector)), r


def tall_least_squares(df: DataFrame, index: str, vector: str, rhs: str, rank: int, sides: int, write: Callable[[DataFrame], DataFrame], block_rows: int = 1 << 16, fan: int = 64) -> np.ndarray:
    """The rank x sides matrix B of least squares over all rows of vector' B - rhs, by the triangle of vectors and right-hand sides together."""
    both = df.select(index, F.concat(vector, rhs).alias("v"))
    _, r = tall_qr(both, index, "v", rank + sides, write, block_rows, fan, with_q=False)
    return least_squares(r[:rank, :rank], r[:rank, rank:])


def least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum-norm least-squares solution, rank decided at machine precision."""
    return np.linalg.lstsq(a, b, rcond=np.finfo(float).eps)[0]


def least_squares_many(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """:func:`least_squares` of a stack of symmetric matrices."""
    value, vector = np.linalg.eigh(a)
    low = np.finfo(float).eps * a.shape[-1] * np.abs(value).max(axis=-1, keepdims=True)
    inverse = np.where(np.abs(value) > low, 1 / np.where(value == 0, 1, value), 0)
    return np.einsum("nij,nj->ni", vector, inverse * np.einsum("nji,nj->ni", vector, b))


def svd_factors(v: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Starting factors from a dense matrix: U sqrt(D) and sqrt(D) V'."""
    u, d, vt = np.linalg.svd(v, full_matrices=False)
    s = np.sqrt(d[:rank])
    return u[:, :rank] * s, s[:, None] * vt[:rank]


def _product(v: DataFrame, fixed: DataFrame, by: str, to: str, vector: str, out: str, rank: int) -> DataFrame:
    """(to, out): sums of x times the vectors of ``fixed`` (by, vector) over the entries of each ``to``; rows without entries are absent."""
    sums = v.join(fixed, by).groupBy(to).agg(*(F.sum(F.col("x") * F.col(vector)[k]).alias(f"s{k}") for k in range(rank)))
    return sums.select(to, each(rank, lambda k: F.col(f"s{k}")).alias(out))


def _times(df: DataFrame, index: str, vector: str, m: np.ndarray) -> DataFrame:
    """Vectors times a small matrix."""
    return df.select(index, each(m.shape[1], lambda k: sum((F.col(vector)[a] * float(m[a, k]) for a in range(m.shape[0])), F.lit(0.0))).alias(vector))


def _gram(df: DataFrame, vector: str, rank: int) -> np.ndarray:
    g = np.zeros((rank, rank))
    for a, b, value in A.gram(df, vector, rank).collect():  # rank x rank numbers
        g[a, b] = value
    return g


def _root(g: np.ndarray, power: float) -> np.ndarray:
    value, q = np.linalg.eigh(g)
    good = value > np.finfo(float).eps * len(g) * max(value.max(), 0)
    return q * np.where(good, np.where(good, value, 1.0) ** power, 0.0)


def _inner(df: DataFrame, a: str, b: str, n: int, m: int) -> np.ndarray:
    """The n x m sums over all rows of products of components of two vectors."""
    row = df.agg(*(F.sum(F.col(a)[x] * F.col(b)[y]).alias(f"s{x}_{y}") for x in range(n) for y in range(m))).head()
    return np.array([0.0 if x is None else x for x in row]).reshape(n, m)


def leading_singular(v: DataFrame, start: DataFrame, rank: int, write: Callable[[DataFrame], DataFrame], tol: float = 1e-10, blocks: int = 4, restarts: int = 30) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """V h (i, w), orthonormal right singular vectors (j, h) and the ``rank`` largest singular values of V(i, j, x), absent cells being 0.

    Block Lanczos on V'V: each of ``blocks`` steps applies it to the newest ``rank`` vectors and takes off,
    twice, what lies along those before; the small matrix of inner products gives the best vectors in
    reach.  It ends when V'V changes each of them by its value to within ``tol`` of the largest, and else
    starts again from them.  A step is two joins with partial sums and sums of rank x rank x blocks
    products; only those reach the driver.  Where V has a lower rank there are fewer vectors.
    """
    span = lambda first, n: F.slice("q", first + 1, n)

    def applied(h: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
        w = write(_product(v, h, "j", "i", "h", "w", n))
        return w, write(_product(v, w, "i", "j", "w", "z", n))

    def orthonormal(df: DataFrame, n: int, scale: float) -> tuple[np.ndarray, int]:
        value, turn = np.linalg.eigh(_inner(df, "z", "z", n, n))
        good = value > max(scale, value.max(initial=0)) * 1e-26 + 1e-300 if scale else value > np.finfo(float).eps * n * max(value.max(initial=0), 0)
        return (turn[:, good] / np.sqrt(value[good])) if good.any() else np.zeros((n, 0)), int(good.sum())

    def times(m: np.ndarray, c: str):
        return each(m.shape[1], lambda k: sum((F.col(c)[a] * float(m[a, k]) for a in range(m.shape[0])), F.lit(0.0)))

    _, z = applied(start, rank)
    turn, n = orthonormal(z, rank, 0.0)
    if not n:
        none = write(z.select("j", F.array().cast("array<double>").alias("h")).limit(0))
        return write(v.select("i", F.array().cast("array<double>").alias("w")).limit(0)), none, np.zeros(0)
    q, rank = write(z.select("j", times(turn, "z").alias("q"))), n
    for _ in range(restarts):
        small, newest, size = np.zeros((0, 0)), rank, rank
        for b in range(blocks):
            _, z = applied(q.select("j", span(size - newest, newest).alias("h")), newest)
            both = write(q.join(z, "j"))
            along = _inner(both, "q", "z", size, newest)
            grown = np.zeros((size, size))
            grown[: len(small), : len(small)] = small
            grown[:, size - newest :], grown[size - newest :, :] = along, along.T
            small, top = grown, float(np.abs(np.linalg.eigvalsh(grown)).max())
            if b == blocks - 1:
                break
            less = lambda m: each(m.shape[1], lambda k: F.col("z")[k] - sum((F.col("q")[a] * float(m[a, k]) for a in range(m.shape[0])), F.lit(0.0)))
            both = write(both.select("j", "q", less(along).alias("z")))
            both = write(both.select("j", "q", less(_inner(both, "q", "z", size, newest)).alias("z")))
            turn, found = orthonormal(both, newest, top * top)
            if not found:  # nothing is left outside
                break
            q, newest, size = write(both.select("j", F.concat("q", times(turn, "z")).alias("q"))), found, size + found
        value, best = np.linalg.eigh(small)
        value, best = value[::-1][:rank], best[:, ::-1][:, :rank]
        h = write(q.select("j", times(best, "q").alias("h")))
        w, z = applied(h, rank)
        far = z.join(h, "j").select(each(rank, lambda k: F.col("z")[k] - F.col("h")[k] * float(value[k])).alias("z"))
        if np.sqrt(np.diag(_inner(far, "z", "z", rank, rank)).max()) <= tol * value[0]:
            break
        q = write(h.select("j", F.col("h").alias("q")))
    return w, h, np.sqrt(np.maximum(value, 0))


def svd_start(v: DataFrame, start: DataFrame, rank: int, write: Callable[[DataFrame], DataFrame], tol: float = 1e-10) -> tuple[DataFrame, DataFrame]:
    """Starting factors U sqrt(D) and V sqrt(D) of the leading ``rank`` singular triples of V(i, j, x), absent cells being 0, found from ``start`` (j, h).

    Rows and columns without entries are absent from the result: their vectors are 0.  Components
    beyond the rank of V are 0 too.
    """
    w, h, value = leading_singular(v, start, rank, write, tol)
    padded = lambda power: np.hstack([np.diag(np.where(value > 0, np.where(value > 0, value, 1.0) ** power, 0.0)), np.zeros((len(value), rank - len(value)))])
    return _times(w, "i", "w", padded(-0.5)), _times(h, "j", "h", padded(0.5))
