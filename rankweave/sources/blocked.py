"""Blocked, projected and described matrices on disk: Parquet partitions with a JSON or XML description."""

from __future__ import annotations

import json
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Blocking, MatrixMeta, Projected
from ..operators.reshape import with_blocks
from .matrix_market import numbered_lines, read_coordinate, write_coordinate


def _put(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _get(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path).collect())  # a description, a few lines


def write_blocked(v: DataFrame, meta: MatrixMeta, blocks1: int, blocks2: int, path: str) -> None:
    """Entries in folders b1=/b2=, and their description as ``description.json`` and ``description.xml`` beside them; readers prune blocks by folder."""
    rows, cols = Blocking(meta.size1, blocks1), Blocking(meta.size2, blocks2)
    with_blocks(v, rows, cols).repartition("b1", "b2").sortWithinPartitions("b1", "b2", "i", "j").write.partitionBy("b1", "b2").parquet(f"{path}/blocks")
    about = {"size1": meta.size1, "size2": meta.size2, "blocks1": blocks1, "blocks2": blocks2}
    _put(v.sparkSession, f"{path}/description.json", json.dumps(about | {"offsets1": rows.offsets, "offsets2": cols.offsets}))
    write_descriptor(v.sparkSession, f"{path}/description.xml", about | {"blockOffsets1": rows.offsets, "blockOffsets2": cols.offsets, "path": f"{path}/blocks", "format": "parquet"})


def read_blocked(spark: SparkSession, path: str, blocks1: list[int] | None = None, blocks2: list[int] | None = None) -> tuple[DataFrame, MatrixMeta]:
    """V(i, j, x) of all or only the named blocks; other blocks' files are not opened.  ``path`` is the folder, or an XML description that names one."""
    if path.endswith(".xml"):
        x = read_descriptor(spark, path)
        if x["format"][0] != "parquet":
            return read_block_files(spark, path, blocks1, blocks2)
        size1, size2, data = int(x["size1"][0]), int(x["size2"][0]), x["path"][0]
    else:
        d = json.loads(_get(spark, f"{path}/description.json"))
        size1, size2, data = d["size1"], d["size2"], f"{path}/blocks"
    v = spark.read.parquet(data)
    for c, own in (("b1", blocks1), ("b2", blocks2)):
        if own is not None:
            v = v.filter(F.col(c).isin(own))
    return v.select("i", "j", "x"), MatrixMeta(size1, size2)


def write_block_files(v: DataFrame, meta: MatrixMeta, blocks1: int, blocks2: int, path: str, base: str = "block") -> None:
    """One MatrixMarket file ``base-b1-b2.mmc`` a block, also where it is empty, with indexes from the block's first ones on, and ``base.xml``, which names them.

    Blocks are written side by side as text; the driver then moves each file to its name.
    """
    spark, rows, cols = v.sparkSession, Blocking(meta.size1, blocks1), Blocking(meta.size2, blocks2)
    place = with_blocks(v.select("i", "j", "x"), rows, cols)
    every = spark.range(blocks1 * blocks2).select(F.floor(F.col("id") / blocks2).alias("b1"), (F.col("id") % blocks2).alias("b2"))
    counts = every.join(place.groupBy("b1", "b2").agg(F.count("*").alias("n")), ["b1", "b2"], "left")
    long = lambda own, b: F.element_at(F.array(*(F.lit(y - x) for x, y in zip(own.offsets, [*own.offsets[1:], own.size]))), (F.col(b) + 1).cast("int"))
    size = F.concat_ws(" ", long(rows, "b1"), long(cols, "b2"), F.coalesce("n", F.lit(0)))
    banner = counts.select("b1", "b2", F.lit(-2).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit("%%MatrixMarket matrix coordinate real general").alias("value"))
    head = counts.select("b1", "b2", F.lit(-1).cast("long"), F.lit(0).cast("long"), size)
    line = F.concat_ws(" ", F.col("i") - rows.start(F.col("b1")) + 1, F.col("j") - cols.start(F.col("b2")) + 1, F.col("x").cast("double").cast("string"))
    text = banner.union(head).union(place.select("b1", "b2", "i", "j", line)).withColumn("file", F.concat_ws("-", F.lit(base), "b1", "b2"))
    text.repartition("file").sortWithinPartitions("file", "i", "j").select("file", "value").write.partitionBy("file").text(f"{path}/{base}-parts")
    names = [f"{base}-{b1}-{b2}.mmc" for b1 in range(blocks1) for b2 in range(blocks2)]
    jvm = spark.sparkContext._jvm
    parts = jvm.org.apache.hadoop.fs.Path(f"{path}/{base}-parts")
    fs = parts.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in names:
        (part,) = [f.getPath() for f in fs.listStatus(jvm.org.apache.hadoop.fs.Path(parts, f"file={name.removesuffix('.mmc')}")) if f.getPath().getName().startswith("part-")]
        if not fs.rename(part, jvm.org.apache.hadoop.fs.Path(path, name)):
            raise OSError(f"{name} cannot be written")
    fs.delete(parts, True)
    write_descriptor(spark, f"{path}/{base}.xml", {"size1": meta.size1, "size2": meta.size2, "blocks1": blocks1, "blocks2": blocks2, "blockOffsets1": rows.offsets, "blockOffsets2": cols.offsets, "path": path, "filenames": names, "format": "mmc"})


def read_block_files(spark: SparkSession, description: str, blocks1: list[int] | None = None, blocks2: list[int] | None = None) -> tuple[DataFrame, MatrixMeta]:
    """V(i, j, x) of the coordinate files that an XML description names, row block by row block; files of other blocks are not opened.

    Names lie below the description's path unless they are absolute; a file that is missing, a
    number of names that is not that of the blocks, or a file with another number of entries than
    its head says raises.
    """
    x = read_descriptor(spark, description)
    size1, size2, n1, n2 = (int(x[k][0]) for k in ("size1", "size2", "blocks1", "blocks2"))
    names, starts = x.get("filenames", []), [[int(o) for o in x[f"blockOffsets{k}"]] for k in (1, 2)]
    if len(names) != n1 * n2 or len({n.rsplit("/", 1)[-1] for n in names}) != len(names):
        raise ValueError(f"{description}: {n1} x {n2} blocks and {len(names)} different file names")
    wanted = [(b1, b2) for b1 in (range(n1) if blocks1 is None else blocks1) for b2 in (range(n2) if blocks2 is None else blocks2)]
    if not wanted:
        return spark.createDataFrame([], "i long, j long, x double"), MatrixMeta(size1, size2)
    full = lambda name: name if name.startswith("/") or "://" in name else f"{x['path'][0]}/{name}"
    paths = [full(names[b1 * n2 + b2]) for b1, b2 in wanted]
    places = spark.createDataFrame([(p.rsplit("/", 1)[-1], starts[0][b1], starts[1][b2]) for p, (b1, b2) in zip(paths, wanted)], "file string, o1 long, o2 long")
    lines = spark.read.text(paths).select(F.col("_metadata.file_name").alias("file"), F.trim("value").alias("line")).filter("line <> '' and not startswith(line, '%')")
    # the size line is the only one whose third number is how many others there are, unless an entry looks like it
    p = lines.select("file", F.split("line", r"\s+").alias("p"))
    per = p.groupBy("file").agg(F.count("*").alias("n"), F.max(F.size("p")).alias("most"), F.min(F.size("p")).alias("fewest"))
    heads = spark.read.text(paths).select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"), F.trim("value").alias("line")).filter("line <> '' and not startswith(line, '%')")
    heads = heads.groupBy("file").agg(F.min_by("line", "at").alias("line")).select("file", F.split("line", r"\s+").alias("head"))
    bad = per.join(heads, "file").filter("most <> 3 or fewest <> 3 or cast(head[2] as long) <> n - 1").count()
    if bad or per.count() != len(wanted):
        raise ValueError(f"{description}: {bad} files have another number of entries than they say, {len(wanted) - per.count()} have no head")
    twice = p.join(F.broadcast(heads), "file").filter(F.col("p") == F.col("head")).groupBy("file", "p").agg(F.count("*").alias("k")).filter("k > 1")  # entries that look like the head
    own = p.join(F.broadcast(heads), "file").filter(F.col("p") != F.col("head")).select("file", "p").union(twice.select("file", "p", F.explode(F.sequence(F.lit(2), F.col("k")))).select("file", "p"))
    v = own.join(F.broadcast(places), "file")  # a row a file
    return v.select((F.col("p")[0].cast("long") - 1 + F.col("o1")).alias("i"), (F.col("p")[1].cast("long") - 1 + F.col("o2")).alias("j"), F.col("p")[2].cast("double").alias("x")), MatrixMeta(size1, size2)


def read_some_blocks(spark: SparkSession, path: str, blocks1: int, blocks2: int, wanted: list[tuple[int, int]]) -> tuple[DataFrame, MatrixMeta]:
    """V(i, j, x) of the (b1, b2) blocks of one coordinate file; the values of other entries are not parsed, as the filter on the indexes comes before."""
    v, meta = read_coordinate(spark, path)
    rows, cols = Blocking(meta.size1, blocks1), Blocking(meta.size2, blocks2)
    number = rows.block(F.col("i")) * blocks2 + cols.block(F.col("j"))
    return v.filter(number.isin([b1 * blocks2 + b2 for b1, b2 in wanted])), meta


def write_descriptor(spark: SparkSession, path: str, fields: dict, root: str = "descriptor") -> None:
    """A flat XML description; lists become repeated elements."""
    root = ElementTree.Element(root)
    for k, v in fields.items():
        for x in v if isinstance(v, list) else [v]:
            ElementTree.SubElement(root, k).text = str(x)
    _put(spark, path, ElementTree.tostring(root, encoding="unicode"))


def read_descriptor(spark: SparkSession, path: str) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for e in ElementTree.fromstring(_get(spark, path)):
        out.setdefault(e.tag, []).append(e.text or "")
    return out


def write_map(m: DataFrame, original: int, path: str) -> None:
    """An index map as text: ``size original-size``, then ``new old`` from 1, in parts that follow each other by name."""
    head = m.sparkSession.createDataFrame([(-1, f"{m.count()} {original}")], "new long, value string")
    head.union(m.select("new", F.concat_ws(" ", F.col("new") + 1, F.col("old") + 1))).orderBy("new").select("value").write.text(path)


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """(new, old) from 0.  The head is the first line of the first file."""
    p = F.split("value", r"\s+")
    return numbered_lines(spark, path).filter("n > 0").select((p[0].cast("long") - 1).alias("new"), (p[1].cast("long") - 1).alias("old"))


def write_projected(p: Projected, path: str, *, meta: MatrixMeta | None = None, original: str = "") -> None:
    """A projection as Parquet tables below a folder, or, if ``path`` ends in ``.mfp``, as a description, the matrix and two index maps beside it.

    ``meta`` has the sizes of the matrix it was taken from, whose file is ``original``; the
    description needs both.
    """
    if not path.endswith(".mfp"):
        for name in ("data", "map1", "map2"):
            getattr(p, name).write.parquet(f"{path}/{name}")
        return
    if meta is None:
        raise ValueError("a .mfp file needs the sizes of the matrix it was taken from")
    stem, spark = path.removesuffix(".mfp"), p.data.sparkSession
    write_coordinate(p.data, MatrixMeta(p.map1.count(), p.map2.count()), f"{stem}-projected.mmc")
    write_map(p.map1, meta.size1, f"{stem}-1.mfm")
    write_map(p.map2, meta.size2, f"{stem}-2.mfm")
    name = stem.rsplit("/", 1)[-1]
    write_descriptor(spark, path, {"matrixFilename": original, "projectedMatrixFilename": f"{name}-projected.mmc", "map1Filename": f"{name}-1.mfm", "map2Filename": f"{name}-2.mfm"}, "files")


def read_projected(spark: SparkSession, path: str) -> Projected:
    """What :func:`write_projected` wrote; files named in a description lie beside it unless their paths are absolute."""
    if not path.endswith(".mfp"):
        return Projected(*(spark.read.parquet(f"{path}/{n}") for n in ("data", "map1", "map2")))
    x = read_descriptor(spark, path)
    beside = lambda name: name if name.startswith("/") or "://" in name else f"{path.rsplit('/', 1)[0]}/{name}"
    data, meta = read_coordinate(spark, beside(x["projectedMatrixFilename"][0]))
    return Projected(data, read_map(spark, beside(x["map1Filename"][0])), read_map(spark, beside(x["map2Filename"][0])), meta)
