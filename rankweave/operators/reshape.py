"""Submatrices, renumbering, blocks and element-wise changes of matrices."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import draws
from ..model import Blocking, MatrixMeta, Projected
from ..plans.store import Tables
from ..session import ship
from . import aggregate as A


def renumbered(ids: DataFrame, index: str) -> DataFrame:
    """(new, old): the distinct ids of a column in ascending order.

    Ranks come from range partitions: each is numbered alone and shifted by the sizes of those
    before it, so no single task sorts all ids.  The partitions are written, as two plans must see
    the same ones.
    """
    own = ids.select(F.col(index).cast("long").alias("old")).filter("old is not null").distinct()
    return _ranked(own, "old").select("new", "old")


def _ranked(df: DataFrame, key: str) -> DataFrame:
    """``df`` (distinct ``old``) with ``new``: the place of a row in the order of ``key`` and ``old``."""
    parts = Tables(df.sparkSession).put(df.repartitionByRange(key, "old").withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    ahead = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row a partition
    rank = F.row_number().over(Window.partitionBy("part").orderBy(key, "old"))
    return parts.withColumn("r", rank).join(F.broadcast(ahead), "part").withColumn("new", (F.col("before") + F.col("r") - 1).cast("long"))


def submatrix(v: DataFrame, rows: DataFrame, cols: DataFrame) -> Projected:
    """Entries of the listed rows and columns, renumbered by ``rows`` and ``cols``, tables (new, old)."""
    m1, m2 = rows.select("new", "old"), cols.select("new", "old")
    data = v.join(m1.select(F.col("old").alias("i"), F.col("new").alias("ni")), "i").join(m2.select(F.col("old").alias("j"), F.col("new").alias("nj")), "j")
    return Projected(data.select(F.col("ni").alias("i"), F.col("nj").alias("j"), "x"), m1, m2)


def random_submatrix(v: DataFrame, meta: MatrixMeta, n1: int, n2: int | None = None, seed: int = 1) -> Projected:
    """``n1`` rows and ``n2`` columns drawn without replacement, in ascending order."""
    spark = v.sparkSession

    def draw(size, n, seed):
        if n > size:
            raise ValueError(f"cannot draw {n} of {size}")
        return renumbered(permutation(size, spark, seed).filter(F.col("new") < n), "old")

    n2 = n1 if n2 is None else n2
    return submatrix(v, draw(meta.size1, n1, seed), draw(meta.size2, n2, seed + 1))._replace(meta=MatrixMeta(n1, n2))


def _as_table(v: DataFrame) -> DataFrame:
    """``v`` itself if it is a scan of files, else as written and read back: what several plans read is computed once."""
    try:
        v.metadataColumn("_metadata")
        return v
    except AnalysisException:
        return Tables(v.sparkSession).put(v.select("i", "j", "x"))


def _counted(entries: DataFrame) -> DataFrame:
    """(of_j, old, nnz): entries of each row (of_j = 0) and column (1), in one pass."""
    return entries.groupingSets([["i"], ["j"]], "i", "j").agg(F.count("*").alias("nnz"), F.grouping("i").alias("of_j")).select("of_j", F.coalesce("i", "j").cast("long").alias("old"), "nnz")


def _both_renumbered(ids: DataFrame) -> list[DataFrame]:
    """(new, old) of the rows and of the columns of a table of distinct (of_j, old), ranked together."""
    ranked = _ranked(ids.select("of_j", "old").filter("old is not null"), "of_j")
    rows = ranked.filter("of_j = 0").count()
    return [ranked.filter(F.col("of_j") == k).select((F.col("new") - k * rows).alias("new"), "old") for k in (0, 1)]


def frequent(v: DataFrame | Projected, threshold: int = 0) -> Projected:
    """Rows and columns with more than ``threshold`` entries, counted once on the input; maps of a projected input lead to its own originals."""
    data = _as_table(v.data if isinstance(v, Projected) else v)
    out = submatrix(data, *_both_renumbered(_counted(data).filter(F.col("nnz") > threshold)))
    return Projected(out.data, compose(out.map1, v.map1), compose(out.map2, v.map2)) if isinstance(v, Projected) else out


def nonempty(v: DataFrame | Projected) -> Projected:
    """Rows and columns with any entry."""
    return frequent(v, 0)


def compose(new: DataFrame, old: DataFrame) -> DataFrame:
    """(new, old) of one renumbering after another."""
    return new.select("new", F.col("old").alias("mid")).join(old.select(F.col("new").alias("mid"), "old"), "mid").select("new", "old")


def core(v: DataFrame, threshold: int, write) -> Projected:
    """:func:`frequent` until nothing goes.  ``write`` stores a table and returns it as read back, which cuts the lineage of every round.

    Entries are counted once, by rows and by columns in one pass.  A round cuts the entries of rare rows and
    columns from the others and takes them off the counts, so it reads what is left of the matrix
    once, counts only what goes, and ends when no count is small.
    """
    data = write(v.select("i", "j", "x"))
    counts = write(_counted(data))
    while True:
        rare = counts.filter(F.col("nnz") <= threshold)
        if rare.isEmpty():
            break
        lost = [rare.filter(F.col("of_j") == k).select(F.col("old").alias(c), F.lit(True).alias(f"lost_{c}")) for k, c in enumerate("ij")]
        marked = data.join(lost[0], "i", "left").join(lost[1], "j", "left").select("i", "j", "x", F.coalesce("lost_i", "lost_j", F.lit(False)).alias("gone"))
        marked = write(marked, by=("gone",))
        data, less = (marked.filter(F.col("gone") == k).drop("gone") for k in (False, True))
        left = F.col("nnz") - F.coalesce("less", F.lit(0))
        counts = write(counts.filter(F.col("nnz") > threshold).join(_counted(less).withColumnRenamed("nnz", "less"), ["of_j", "old"], "left").select("of_j", "old", left.alias("nnz")).filter("nnz > 0"))
    return submatrix(data, *_both_renumbered(counts))


def gather(factor: DataFrame, index: str, vector: str, wanted: DataFrame) -> DataFrame:
    """Vectors of ``wanted`` (pos, index) in its order, repeats allowed."""
    return wanted.select("pos", index).join(factor.select(index, vector), index).select("pos", index, vector)


def split_indexes(ids: DataFrame, index: str, blocking: Blocking) -> DataFrame:
    """(index, block, offset): the block of each id and its place in the block."""
    block = blocking.block(F.col(index))
    return ids.select(index, block.alias("block")).withColumn("offset", (F.col(index) - blocking.start(F.col("block"))).cast("long"))


def subrange(v: DataFrame, start1: int, stop1: int, start2: int, stop2: int) -> DataFrame:
    """Entries of [start1, stop1) x [start2, stop2), indexes from 0; the filter reaches a Parquet scan."""
    inside = (F.col("i") >= start1) & (F.col("i") < stop1) & (F.col("j") >= start2) & (F.col("j") < stop2)
    return v.filter(inside).select((F.col("i") - start1).alias("i"), (F.col("j") - start2).alias("j"), "x")


def by_columns(v: DataFrame, partitions: int | None = None) -> DataFrame:
    """The same entries laid out by column."""
    out = v.repartitionByRange(partitions, "j") if partitions else v.repartitionByRange("j")
    return out.sortWithinPartitions("j", "i")


def with_blocks(v: DataFrame, rows: Blocking, cols: Blocking) -> DataFrame:
    """Entries with their block numbers b1 and b2."""
    return v.withColumns({"b1": rows.block(F.col("i")), "b2": cols.block(F.col("j"))})


def per_block(v: DataFrame, rows: Blocking, cols: Blocking, f, schema: str) -> DataFrame:
    """``f(b1, b2, entries)`` on the entries (i, j, x, an Arrow table) of each block, one task a block; ``schema`` is that of the tables it returns."""

    def run(key, own):
        return f(key[0].as_py(), key[1].as_py(), own.select(["i", "j", "x"]))

    return with_blocks(v.select("i", "j", "x"), rows, cols).groupBy("b1", "b2").applyInArrow(run, schema)


def square_blocks(v: DataFrame, meta: MatrixMeta, blocks: int) -> DataFrame:
    """Entries with b1 and b2 of a blocks x blocks grid whose last blocks take what is over."""
    f = lambda index, size: F.least(F.floor(F.col(index) / max(1, size // blocks)), F.lit(blocks - 1)).cast("long")
    return v.withColumns({"b1": f("i", meta.size1), "b2": f("j", meta.size2)})


def permutation(size: int, spark, seed: int) -> DataFrame:
    """(old, new): a random permutation, the same for a seed whatever the cluster."""
    return _ranked(spark.range(size).select(F.col("id").alias("old"), draws.uniform(seed, F.col("id")).alias("r0")), "r0").select("old", "new")


def permuted(factor: DataFrame, index: str, perm: DataFrame) -> DataFrame:
    """The factor with rows (columns) in the order of a permutation (old, new)."""
    rest = [c for c in factor.columns if c != index]
    return factor.join(perm.withColumnRenamed("old", index), index).select(F.col("new").alias(index), *rest)


def mapped(v: DataFrame, expression: str | Column, rows: Sequence[int] | None = None, cols: Sequence[int] | None = None) -> DataFrame:
    """Values replaced by an SQL expression of i, j and x, inside half-open ranges of rows and columns if given."""
    new = F.expr(expression) if isinstance(expression, str) else expression
    inside = F.lit(True)
    for c, r in (("i", rows), ("j", cols)):
        if r is not None:
            inside = inside & (F.col(c) >= r[0]) & (F.col(c) < r[1])
    return v.withColumn("x", F.when(inside, new.cast("double")).otherwise(F.col("x")))


def centred(train: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """``other`` (or ``train`` itself) minus the mean of ``train``; the mean is one row."""
    m = A.mean(train)
    other = train if other is None else other
    return other.join(F.broadcast(m)).withColumn("x", F.col("x") - F.col("mean")).drop("mean")


def noisy(v: DataFrame, distribution, seed: int) -> DataFrame:
    """Values plus noise of a distribution, drawn for each cell."""
    return v.withColumn("x", F.col("x") + distribution.column(seed, F.col("i"), F.col("j")))


def poisson(v: DataFrame, seed: int) -> DataFrame:
    """Values replaced by Poisson draws of that mean, one for each seed and cell; null and negative values become 0."""
    ship(v.sparkSession)

    def run(batches):
        for batch in batches:
            i, j, x = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "x"))
            drawn = draws.poisson_array(np.where(x > 0, x, 0.0), seed, i, j)
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("j"), pa.array(drawn)], names=["i", "j", "x"])

    return v.select("i", "j", "x").mapInArrow(run, "i long, j long, x double")
