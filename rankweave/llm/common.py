"""Session, storage and Arrow helpers that every corpus operator shares.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which
all executors see; a lost executor costs a re-read, not a recomputation of the
stages before the table.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import shared_dir
from ..session import ship


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Store:
    """Named Parquet tables below one shared folder: the points where lineage is cut."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = ship(spark), shared_dir(spark), 0

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read back."""
        self.n += 1
        path = f"{self.path}/{self.n:03d}-{name}"
        was = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")  # what was shuffled for the table is of no use once it is there
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, was) if was else self.spark.conf.unset(CLEANUP)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a table that :meth:`put` returned and nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def two_columns(df: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """``id`` and ``text`` (and ``more``) alone, so that extra or clashing columns never reach an operator."""
    ship(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *more)


def fold(id_col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``: the folds of the contracts."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings (or binaries) end to end, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def release() -> None:
    """Give freed memory back to the system: Python workers live on after a task, beside those of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def pieces(batches: Iterator[pa.RecordBatch], text_col: str = "text", size: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about ``size`` bytes of text (one longer text may stand alone), with bytes and offsets."""
    for batch in batches:
        data, at = utf8(batch.column(text_col))
        start, n = 0, batch.num_rows
        while start < n:
            stop = max(start + 1, int(np.searchsorted(at, at[start] + size, side="right")) - 1)
            yield batch.slice(start, stop - start), data[at[start] : at[stop]], at[start : stop + 1] - at[start]
            start = stop
    release()


def table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A batch from NumPy arrays, lists or Arrow arrays."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def with_row_key(docs: DataFrame, store: Store) -> tuple[DataFrame, str]:
    """``docs`` with a 64-bit hash of each row's file and place in it, and that column's name.

    The key is the same in every job, however the files are split; input that is no scan of files
    is written first.  Two rows of one id share a key with probability 2**-64.
    """
    name = "row_key"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    try:
        place = docs.metadataColumn("_metadata")
        return docs.withColumn(name, F.xxhash64(place["file_path"], place["row_index"])), name
    except AnalysisException:
        return with_row_key(store.put(docs, "docs"), store)


def near_fraction(rows: DataFrame, key: str, most: int) -> DataFrame:
    """Rows of about ``2 * most`` values of ``key``, by the smallest hashes; all rows if their values are no more than that.  No text is read, only sketches are moved."""
    n = rows.agg(F.approx_count_distinct(key)).head()[0]
    if n <= 2 * most:
        return rows
    return rows.filter(F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(41)), 1) < F.lit(int(2 * most / n * (1 << 63))))


def bounded_sample(rows: DataFrame, most: int, text_col: str | None = None, most_bytes: int = 64 << 20) -> DataFrame:
    """At most ``most`` distinct rows with at most ``most_bytes`` of text in all, in the order of their hashes.

    Equal rows count once; a row whose text is over what is left of ``most_bytes`` is passed over.
    The driver sees ``most`` hashes and lengths.
    """
    order = F.xxhash64(*[F.col(c) for c in rows.columns], F.lit(43)).alias("sample_order")
    keyed = rows.select("*", order).dropDuplicates(["sample_order"])
    size = F.octet_length(text_col) if text_col else F.lit(0)
    taken, left = [], most_bytes
    for h, n in keyed.select("sample_order", F.coalesce(size, F.lit(0)).alias("n")).orderBy("sample_order").limit(most).collect():
        if n <= left:
            taken.append((h,))
            left -= n
    picks = rows.sparkSession.createDataFrame(taken, "sample_order long")
    return keyed.join(F.broadcast(picks), "sample_order").drop("sample_order")  # ``most`` numbers
