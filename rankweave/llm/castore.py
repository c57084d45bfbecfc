"""Token ids as a content-addressed store on files that any Hadoop file system can hold.

A rolling hash over the last ``WINDOW`` ids cuts each document's id stream where the content
says so, hence an edit moves only the cuts near it and copies fall into equal chunks.  Layout
below one folder, all Parquet:

``raw``       kind=chunk has (key, n, data): each distinct chunk once; ``data`` is its ``n`` ids as little-endian
              unsigned integers, of 16 bits if all fit and else of 32, ``key`` the 16-byte BLAKE2b of ``data``.
``recipes``   (part, id, start, n, root, digests): in ascending id order, part by part; ``digests``
              rebuild the document in order, ``root`` is the root of their Merkle tree.
``manifest``  (part, docs, tokens, first, root): ``root`` is the Merkle root of the part's document
              roots, so a reader can verify any part, document or chunk alone.

The corpus crosses the network once, as ids by digest; recipes are a few dozen bytes a document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zlib
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words as W
from .common import Store, pieces, table, two_columns, utf8
from .tokens import END_ID, default_path, encoder

WINDOW, LEAST, MASK, MOST = 16, 64, 255, 1024
#: Digests that a task remembers, documents of a part of the recipes.
SEEN, PART_DOCS = 1 << 18, 1 << 17
CUT = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("data", pa.binary()), ("root", pa.binary()), ("digests", pa.list_(pa.binary()))])
CUT_SQL = "row long, id long, n long, key binary, data binary, root binary, digests array<binary>"
READ = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("crc", pa.int64())])
DOC = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("crc", pa.int64())])


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def stored(ids: np.ndarray) -> bytes:
    """A chunk's bytes: two an id if all are below 2**16, else four."""
    return ids.astype("<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4").tobytes()


def loaded(data, n: int) -> np.ndarray:
    """The ids of a chunk of ``n``, as little-endian unsigned 32-bit integers."""
    return np.frombuffer(data, f"<u{len(data) // n}" if n else "<u2").astype("<u4", copy=False)


def merkle(leaves: list[bytes]) -> bytes:
    """Root of the binary tree over ``leaves``; an odd last node goes up as it is, leaves and nodes are hashed under different tags."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def cuts(ids: np.ndarray, at: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each document in ``ids``, whose bounds are ``at``: where the rolling hash of the document's last ids is 0 under the mask, no chunk below ``LEAST`` or above ``MOST`` ids but the last."""
    n = len(ids)
    up, down = W._powers(n + 1)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(W.mix(ids.astype(np.uint64) + np.uint64(77)) * up[:n], out=run[1:])
    hashed = W.mix((run[WINDOW:] - run[: n + 1 - WINDOW]) * down[: n + 1 - WINDOW]) if n >= WINDOW else np.zeros(0, np.uint64)
    where = np.flatnonzero(hashed & np.uint64(MASK) == 0) + WINDOW
    doc = np.searchsorted(at, where, side="left") - 1
    where = where[where - at[doc] >= WINDOW]  # a window lies in one document
    first = np.searchsorted(where, at, side="left")
    spots, out = where.tolist(), []
    for start, stop, a, b in zip(at[:-1].tolist(), at[1:].tolist(), first[:-1].tolist(), first[1:].tolist()):
        ends, last = [], start
        for c in (*spots[a:b], stop):
            while c - last > MOST:
                last += MOST
                ends.append(last)
            if c - last >= LEAST or c == stop and c > last:
                ends.append(c)
                last = c
        out.append(ends)
    return out


def cut(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Recipe rows (``digests`` set) and chunk rows (``data`` set) of one encoding pass; a task sends a chunk once (of its last ``SEEN`` ones)."""

    def run(batches):
        enc, sent = encoder(tokenizer), set()
        for batch, data, at in pieces(batches):
            rows, own = [], {}
            end = np.array([END_ID], np.int32)
            each = enc.encode(data, at)
            ids = np.concatenate([x for own_ids in each for x in (own_ids, end)])
            bounds = np.concatenate([[0], np.cumsum([len(x) + 1 for x in each])])
            for row, i, a, z, ends in zip(batch.column("row").to_pylist(), batch.column("id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), cuts(ids, bounds)):
                names, n = [], z - a
                for b in ends:
                    part = stored(ids[a:b])
                    names.append(key := digest(part))
                    own[key] = b - a, part
                    a = b
                rows.append((row, i, n, row.to_bytes(8, "little"), None, merkle(names), names))
            rows += [(None, None, n, k, v, None, None) for k, (n, v) in own.items() if k not in sent]
            sent = sent | own.keys() if len(sent) < SEEN else set(own)
            yield table(CUT, *map(list, zip(*rows)))

    return docs.mapInArrow(run, CUT_SQL)


def write_store(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, parts: int | None = None) -> None:
    """Encode ``docs`` and write chunks, recipes and manifest below ``path``.

    Null text is empty (its stream is the end id alone); null ids come first, repeated ids and
    rows each get a recipe of their own, an empty table gives empty files.
    """
    spark = docs.sparkSession
    docs = two_columns(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    both = cut(docs, tokenizer or default_path()).withColumn("kind", F.when(F.col("data").isNull(), "recipe").otherwise("chunk"))
    both.repartition("key").dropDuplicates(["key"]).write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/raw")
    raw = _raw(spark, path, "recipe").select("id", "n", "root", "digests")
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + raw.count() // PART_DOCS)
    ranged = raw.repartitionByRange(parts, F.col("id").asc_nulls_first(), "root").sortWithinPartitions(F.col("id").asc_nulls_first(), "root").withColumn("part", F.spark_partition_id())
    ranged.write.parquet(f"{path}/ranged")
    ranged = spark.read.parquet(f"{path}/ranged")
    sizes = ranged.groupBy("part").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    first = sizes.withColumn("first", F.coalesce(F.sum("tokens").over(ahead), F.lit(0)))
    within = Window.partitionBy("part").orderBy(F.col("id").asc_nulls_first(), "root").rowsBetween(Window.unboundedPreceding, -1)
    recipes = ranged.join(F.broadcast(first), "part").withColumn("start", F.col("first") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    recipes.select("part", "id", "start", "n", "root", "digests").write.parquet(f"{path}/recipes")

    def roots(key, own):
        roots = own.sort_by("start").column("root").to_pylist()
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "root": pa.array([merkle(roots)], pa.binary())})

    trees = spark.read.parquet(f"{path}/recipes").select("part", "start", "root").groupBy("part").applyInArrow(roots, "part int, root binary")
    first.join(trees, "part").select("part", "docs", "tokens", "first", "root").write.parquet(f"{path}/manifest")
    _delete(spark, f"{path}/ranged")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _raw(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(f"{CUT_SQL}, kind string").parquet(f"{path}/raw").filter(F.col("kind") == kind)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return _raw(spark, path, "chunk").select("key", "n", "data")


def recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, id long, start long, n long, root binary, digests array<binary>").parquet(f"{path}/recipes")


def verify_manifest(spark: SparkSession, path: str) -> None:
    """Hold the recipes against the manifest: each part's number of documents, ids and Merkle root, and where each document and part starts; any difference raises."""
    first = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    parts = spark.read.parquet(f"{path}/manifest").withColumn("before", F.coalesce(F.sum("tokens").over(first), F.lit(0)))

    def check(key, own, listed):
        own, said = own.sort_by([("start", "ascending"), ("root", "ascending")]), listed.to_pylist()
        n, start = (own.column(c).to_numpy() for c in ("n", "start"))
        if len(said) != 1 or said[0]["first"] != said[0]["before"] or said[0]["docs"] != len(n) or said[0]["tokens"] != n.sum():
            raise ValueError(f"part {key[0]} is not what the manifest says")
        if not np.array_equal(start, said[0]["first"] + np.cumsum(n) - n):
            raise ValueError(f"a document of part {key[0]} starts elsewhere")
        if merkle(own.column("root").to_pylist()) != said[0]["root"]:
            raise ValueError(f"part {key[0]} differs from its Merkle root")
        return pa.table({"ok": pa.array([1])})

    recipes(spark, path).select("part", "start", "n", "root").groupBy("part").cogroup(parts.groupBy("part")).applyInArrow(check, "ok long").count()


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, ids): every document rebuilt from its chunks, as an array of ids."""
    refs = recipes(spark, path).select("id", "start", F.posexplode("digests").alias("pos", "key"))
    joined = refs.join(chunks(spark, path), "key")

    def build(key, own):
        own = own.sort_by("pos")
        ids = np.concatenate([loaded(d, n) for d, n in zip(own.column("data").to_pylist(), own.column("n").to_pylist())]).astype(np.int64)
        return pa.table({"id": pa.array([key[1].as_py()], pa.int64()), "start": pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64()))})

    return joined.groupBy("start", "id").applyInArrow(build, "id long, start long, ids array<long>")


def _shift_tables() -> np.ndarray:
    """Table b: what each of the 32 bits of a CRC-32 becomes when ``4 * 2**b`` zero bytes follow."""
    one = np.array([zlib.crc32(b"\0" * 4, 1 << k) ^ zlib.crc32(b"\0" * 4, 0) for k in range(32)], np.uint64)
    out = [one]
    for _ in range(39):
        out.append(_apply(out[-1], out[-1]))
    return np.stack(out)


def _apply(matrix: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = np.zeros_like(crc)
    for k in range(32):
        out ^= np.where((crc >> np.uint64(k)) & np.uint64(1) == 1, matrix[k], np.uint64(0))
    return out


def joined_crc(crc: np.ndarray, after: np.ndarray, at: np.ndarray) -> np.ndarray:
    """CRC-32 of concatenations: of parts with CRC ``crc`` that ``after`` four-byte ids follow; ``at`` are the n + 1 bounds of the wholes."""
    crc, tables = crc.astype(np.uint64), _shift_tables()
    for b in range(int(after.max(initial=0)).bit_length()):
        odd = (after >> b) & 1 == 1
        crc[odd] = _apply(tables[b], crc[odd])
    return np.bitwise_xor.reduceat(crc, at[:-1]) if len(crc) else crc


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n, crc): read the files back and verify them.

    The recipes are held against the manifest first.  Every chunk is read once, its digest recomputed from its ids; a document's Merkle root is
    recomputed from the verified digests and its length from the chunks' lengths, and any
    difference raises.  Its CRC-32 is that of its chunks joined, so no ids travel.
    """

    def scan(batches):
        for batch in batches:
            data, at = utf8(batch.column("data"))
            n, raw, cut_at = batch.column("n").to_pylist(), memoryview(data), at.tolist()
            parts = [raw[a:b] for a, b in zip(cut_at, cut_at[1:])]
            keys = [digest(x) for x in parts]
            if keys != batch.column("key").to_pylist():
                raise ValueError("a chunk differs from its digest")
            yield table(READ, keys, n, [zlib.crc32(loaded(x, k)) for x, k in zip(parts, n)])

    verify_manifest(spark, path)
    found = chunks(spark, path).mapInArrow(scan, "key binary, n long, crc long")
    refs = recipes(spark, path).select("id", "start", "n", "root", F.posexplode("digests").alias("pos", "key"))
    back = refs.join(found.withColumnRenamed("n", "size"), "key", "left")
    whole = back.groupBy("start", "id", "n", "root").agg(F.sort_array(F.collect_list(F.struct("pos", "key", "size", "crc"))).alias("x"))
    whole = whole.select("id", "start", "n", "root", F.col("x.key").alias("keys"), F.col("x.size").alias("sizes"), F.col("x.crc").alias("crcs"))

    def check(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            for root, keys in zip(batch.column("root").to_pylist(), batch.column("keys").to_pylist()):
                if merkle(keys) != root:
                    raise ValueError("a document differs from its Merkle root")
            sizes = batch.column("sizes")
            at = np.concatenate([[0], np.cumsum(sizes.value_lengths().to_numpy())])
            size, crc = sizes.flatten(), batch.column("crcs").flatten()
            if size.null_count:
                raise ValueError("a chunk is missing")
            size = size.to_numpy()
            ends = np.cumsum(size)
            total = np.add.reduceat(size, at[:-1])
            if not np.array_equal(total, batch.column("n").to_numpy()):
                raise ValueError("a document has another length")
            yield table(DOC, batch.column("id"), batch.column("start"), batch.column("n"), joined_crc(crc.to_numpy(), np.repeat(ends[at[1:] - 1], np.diff(at)) - ends, at).astype(np.int64))

    return whole.mapInArrow(check, "id long, start long, n long, crc long")


def op1_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the whole ``documents`` table as a content-addressed store, read it back and report each document."""
    path = Store(spark).path
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_digests(spark, path).select(F.col("id").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
