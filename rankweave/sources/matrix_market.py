"""Matrix files in MatrixMarket text, coordinate (sparse) and array (dense) form, and other formats by extension."""

from __future__ import annotations

import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import MatrixMeta
from ..plans.store import Tables
from ..session import ship

#: Cells of a part of array text, and lines that a task hands on together.
PART_CELLS, LINES = 4_000_000, 100_000

FORMATS = {"mmc": "coordinate", "mma": "array", "parquet": "parquet", "csv": "csv", "mfp": "projected", "mfm": "map", "rm": "random", "xml": "blocked"}
SPARSE = {"coordinate": True, "array": False, "parquet": True, "csv": True, "projected": True, "random": True, "blocked": True, "map": False}


def format_of(path: str) -> str:
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ext in ("bst", "bsb", "bdt", "bdb"):
        raise NotImplementedError("binary archives are bound to one platform; use Parquet")
    if ext not in FORMATS:
        raise ValueError(f"unknown matrix file {path!r}")
    return FORMATS[ext]


def is_sparse(fmt: str) -> bool:
    return SPARSE[fmt]


def natural(name: str) -> list:
    """A sort key of file names in which numbers count as numbers."""
    return [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", name)]


def _files(spark: SparkSession, path: str) -> list[str]:
    return sorted(spark.read.text(path).inputFiles(), key=natural)


def _head(spark: SparkSession, path: str) -> tuple[list[str], MatrixMeta, int | None]:
    """Banner words, sizes and number of entries (coordinate form); the driver reads the first lines of the first file that has any."""
    banner = None
    for file in _files(spark, path):
        lines = spark.read.text(file)
        if banner is None:
            first = lines.head(1)
            if not first:
                continue
            banner = first[0].value.split()
            if len(banner) != 5 or banner[0] != "%%MatrixMarket" or banner[1] != "matrix":
                raise ValueError(f"{path}: not a MatrixMarket banner: {first[0].value!r}")
        for row in lines.filter("trim(value) <> '' and not startswith(value, '%')").head(1):  # after any number of comments
            sizes = [int(x) for x in row.value.split()]
            return banner, MatrixMeta(sizes[0], sizes[1]), sizes[2] if len(sizes) > 2 else None
    raise ValueError(f"{path}: no sizes")


def matrix_info(spark: SparkSession, path: str) -> dict:
    """Rows, columns, entries (cells of the array form), and the banner's form, field and symmetry."""
    banner, meta, n = _head(spark, path)
    return {"rows": meta.size1, "cols": meta.size2, "entries": meta.size1 * meta.size2 if n is None else n, "form": banner[2], "field": banner[3], "symmetry": banner[4]}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): trimmed lines that are no comments and not empty, numbered from 0 in the order of files by name and of lines in them.

    Splits are numbered alone and shifted by those before; they are written first, as two plans
    must see the same ones.  The numbers of a split follow each other as written, so nothing is
    sorted.  The driver sees two numbers a split.
    """
    place = F.col("_metadata")
    lines = spark.read.text(path).select(F.trim("value").alias("value"), place["file_path"].alias("file"), place["file_block_start"].alias("first")).filter("value <> '' and not startswith(value, '%')")
    lines = Tables(spark).put(lines.withColumns({"at": F.monotonically_increasing_id(), "split": F.xxhash64("file", "first")}))
    splits = lines.groupBy("file", "first", "split").agg(F.count("*").alias("n"), F.min("at").alias("low")).collect()
    if len({r.split for r in splits}) < len(splits):
        raise ValueError(f"{path}: two splits have one hash")
    shifts, total = [], 0
    for r in sorted(splits, key=lambda r: (natural(r.file), r.first)):
        shifts.append((r.split, total - r.low))
        total += r.n
    shift = spark.createDataFrame(shifts, "split long, shift long")
    return lines.join(F.broadcast(shift), "split").select((F.col("at") + F.col("shift")).alias("n"), "value")


def read_coordinate(spark: SparkSession, path: str) -> tuple[DataFrame, MatrixMeta]:
    """V(i, j, x) with 0-based indexes.

    Banners ``general``, ``symmetric`` and ``skew-symmetric``, ``real``, ``integer`` and ``pattern``
    (entries without values, all 1); another number of entries than the head says raises.
    """
    banner, meta, n = _head(spark, path)
    if banner[2] != "coordinate" or banner[3] not in ("real", "integer", "pattern") or banner[4] not in ("general", "symmetric", "skew-symmetric"):
        raise ValueError(f"{path}: {' '.join(banner[2:])} is not supported")
    width = 2 if banner[3] == "pattern" else 3
    lines = spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> '' and not startswith(line, '%')")
    rows = lines.select(F.split("line", r"\s+").alias("p")).select("p", (F.concat_ws(" ", "p") == f"{meta.size1} {meta.size2} {n}").alias("head"))
    fits = F.size("p") == width
    bad, same, total = rows.agg(F.count_if(~fits & ~F.col("head")), F.count_if("head"), F.count_if(fits & ~F.col("head"))).first()
    # the size line is one row more, and goes once; an entry may look like it
    extra = same - 1 if width == 3 else 0
    if bad or same < 1 or total + extra != n or width == 2 and same > 1:
        raise ValueError(f"{path}: {n} entries announced, {total + extra} found, {bad} lines of another form")
    x = F.lit(1.0) if width == 2 else F.col("p")[2].cast("double")
    cells = lambda df: df.select((F.col("p")[0].cast("long") - 1).alias("i"), (F.col("p")[1].cast("long") - 1).alias("j"), x.alias("x"))
    v = cells(rows.filter(~F.col("head") & fits))
    if extra:
        v = v.union(cells(rows.filter("head").limit(extra)))
    if banner[4] != "general":
        sign = -1 if banner[4] == "skew-symmetric" else 1
        v = v.union(v.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("x") * sign))
    return v, meta


def read_array(spark: SparkSession, path: str) -> tuple[DataFrame, MatrixMeta]:
    """Dense values in column-major order as V(i, j, x); one value a line, in one file or in parts ordered by name."""
    banner, meta, _ = _head(spark, path)
    if banner[2] != "array" or banner[3] not in ("real", "integer") or banner[4] != "general":
        raise ValueError(f"{path}: {' '.join(banner[2:])} is not supported")
    rows = numbered_lines(spark, path)
    found = rows.count() - 1  # the size line is no value
    if found != meta.size1 * meta.size2:
        raise ValueError(f"{path}: {meta.size1 * meta.size2} values announced, {found} found")
    rows = rows.filter("n > 0").withColumn("n", F.col("n") - 1)
    return rows.select((F.col("n") % meta.size1).alias("i"), F.floor(F.col("n") / meta.size1).alias("j"), F.col("value").cast("double").alias("x")), meta


def read_index(spark: SparkSession, path: str, values: int = 1) -> DataFrame:
    """(key, value) or, with two values, (key, value1, value2) of a tab-separated index without a head; keys stay as in the file."""
    names = ["value"] if values == 1 else [f"value{k + 1}" for k in range(values)]
    return spark.read.option("quote", "").schema("key long, " + ", ".join(f"{x} string" for x in names)).csv(path, sep="\t")


def read_matrix(spark: SparkSession, path: str, fmt: str | None = None) -> tuple[DataFrame, MatrixMeta]:
    """V(i, j, x) and its sizes from any readable format; CSV has columns i, j, x from 0."""
    fmt = fmt or format_of(path)
    if fmt == "coordinate":
        return read_coordinate(spark, path)
    if fmt == "array":
        return read_array(spark, path)
    if fmt in ("parquet", "csv"):
        v = spark.read.parquet(path).select("i", "j", "x") if fmt == "parquet" else spark.read.schema("i long, j long, x double").csv(path)
        top = v.agg(F.max("i"), F.max("j")).first()
        return v, MatrixMeta((top[0] if top[0] is not None else -1) + 1, (top[1] if top[1] is not None else -1) + 1)
    raise ValueError(f"{fmt} is not a single matrix: see sources.described")


def _lines(rows: DataFrame, order: tuple[str, ...], path: str, single: bool) -> None:
    """Text in the order of columns: parts by range, whose names are in that order, or one part."""
    (rows.coalesce(1).sortWithinPartitions(*order) if single else rows.orderBy(*order)).select("value").write.text(path)


def write_coordinate(v: DataFrame, meta: MatrixMeta, path: str, single: bool = False) -> None:
    """MatrixMarket coordinate text with 17 significant digits and 1-based indexes, in parts that follow each other by name; one part if ``single``."""
    n = v.count()
    head = v.sparkSession.createDataFrame([(-2, 0, "%%MatrixMarket matrix coordinate real general"), (-1, 0, f"{meta.size1} {meta.size2} {n}")], "i long, j long, value string")
    body = v.select("i", "j", F.format_string("%d %d %.16e", F.col("i") + 1, F.col("j") + 1, F.col("x")).alias("value"))
    _lines(head.union(body), ("i", "j"), path, single)


def write_array(dense: DataFrame, meta: MatrixMeta, path: str, single: bool = False, ends: tuple[float, ...] = ()) -> None:
    """MatrixMarket array text, column by column, in parts that follow each other by name; cells that ``dense`` lacks are 0.

    A part is a range of cells in the file's order (``ends``: the shares of all cells where parts
    end).  Only the cells of ``dense`` are shuffled; a task writes those and the zeros between them as
    it meets them, many lines a row.  Values are the shortest numbers that give the same double.
    """
    spark, total, rows = ship(dense.sparkSession), meta.size1 * meta.size2, meta.size1
    parts = len(ends) or (1 if single else max(1, -(-total // PART_CELLS)))
    stops = [int(total * x) for x in ends] or [total * (k + 1) // parts for k in range(parts)]
    n = (F.col("j") * rows + F.col("i")).cast("long")
    part = sum((F.when(F.col("n") < stop, 0).otherwise(1) for stop in stops[:-1]), F.lit(0)) if ends else F.expr(f"((n + 1) * {parts} - 1) div {max(total, 1)}")
    cells = dense.select(n.alias("n"), F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("x")).filter(F.col("n") < total)
    every = spark.range(parts).select(F.col("id").cast("int").alias("part"), F.lit(-1).cast("long").alias("n"), F.lit(0.0).alias("x"))
    dealt = every.union(cells.select(part.cast("int").alias("part"), "n", "x")).repartitionById(parts, F.col("part")).sortWithinPartitions("n")

    def run(batches):
        zeros, lines, held, at, stop = "0\n" * LINES, [], 0, None, 0
        for k, n, x in itertools.chain((r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("part", "n", "x")))), [(None, None, None)]):
            if k is not None and at is None:
                at, stop = stops[k - 1] if k else 0, stops[k]
                if k == 0:
                    lines = [f"%%MatrixMarket matrix array real general\n{rows} {meta.size2}"]
            if at is None or n == -1:
                continue
            gap = (stop if n is None else n) - at
            if gap < 0:
                raise ValueError(f"cell {n} is there twice")
            at += gap
            while gap:
                more = min(gap, LINES - held)
                lines.append(zeros[: 2 * more - 1])
                gap, held = gap - more, held + more
                if held == LINES:
                    yield pa.record_batch({"value": ["\n".join(lines)]})
                    lines, held = [], 0
            if n is not None:
                lines.append(repr(x))
                at, held = at + 1, held + 1
                if held == LINES:
                    yield pa.record_batch({"value": ["\n".join(lines)]})
                    lines, held = [], 0
        if lines:
            yield pa.record_batch({"value": ["\n".join(lines)]})

    dealt.mapInArrow(run, "value string").write.text(path)


def write_matrix(v: DataFrame, meta: MatrixMeta, path: str, fmt: str | None = None, *, dense: bool = False, single: bool = False) -> None:
    fmt = fmt or format_of(path)
    if fmt == "coordinate":
        if dense:
            raise NotImplementedError("a dense matrix is not written in coordinate form")
        write_coordinate(v, meta, path, single)
    elif fmt == "array":
        write_array(v, meta, path, single)
    elif fmt == "parquet":
        v.write.parquet(path)
    elif fmt == "csv":
        v.select("i", "j", "x").write.csv(path)
    else:
        raise ValueError(f"{fmt} is not written by this function")


def convert(spark: SparkSession, source: str, target: str) -> None:
    v, meta = read_matrix(spark, source)
    write_matrix(v, meta, target)


def read_factor(spark: SparkSession, path: str, side: str) -> DataFrame:
    """W(i, w) from a rows x rank array file, or H(j, h) from a rank x columns one."""
    v, _ = read_matrix(spark, path)
    index, vector, k = ("i", "w", "j") if side == "w" else ("j", "h", "i")
    return v.groupBy(index).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(k).alias("k"), "x"))), lambda s: s["x"]).alias(vector))
