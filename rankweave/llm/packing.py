"""Documents packed into token sequences of fixed capacity by the sum-of-squares rule.

Let N(g) be the number of open sequences with g free places.  A piece goes where the sum of
N(g)**2 over all gaps becomes smallest, so that no gap piles up without pieces to fill it
(Csirik et al., 2006).  Pieces come in decreasing length, and a sequence is opened only when
none has room; both keep the number of sequences within 0.2 % of the total length here.

Only lengths travel to the packer.  It works in shards of about ``SHARD`` random pieces: sums of
squares need no more to be near the bound, and each shard is one task of bounded memory.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store, pieces, table, two_columns
from .tokens import END_ID, default_path, encoder

SHARD = 131_072
PIECE = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
PIECE_SQL = "row long, id long, piece int, start long, length long, ids_crc32 long, ids binary"


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; lengths are from 1 to ``capacity``."""
    open_, count = [[] for _ in range(capacity + 1)], np.zeros(capacity + 1, np.int64)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    bins, none = 0, 1 << 60
    for k in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[k])
        gap = capacity
        if s < capacity:
            rise = np.where(count[s:capacity] > 0, 1 - 2 * count[s:capacity], none)
            rise[1:] += 2 * count[1 : capacity - s] + 1  # the gap that is left gains one; a full sequence has none
            best = int(rise.argmin())
            if rise[best] < none // 2:
                gap = s + best
        if gap == capacity:
            sequence[k] = bins
            bins += 1
        else:
            sequence[k] = open_[gap].pop()
            count[gap] -= 1
        offset[k] = capacity - gap
        if gap > s:
            open_[gap - s].append(sequence[k])
            count[gap - s] += 1
    return sequence, offset


def cut_pieces(docs: DataFrame, capacity: int, tokenizer: str, keep_ids: bool) -> DataFrame:
    """(row, id, piece, start, length, ids_crc32, ids): each document's ids and end id; a longer one in pieces of ``capacity``, the first with what is over.  ``ids`` are null unless kept."""

    def run(batches):
        enc = encoder(tokenizer)
        for batch, data, at in pieces(batches):
            rows = []
            for row, i, ids in zip(batch.column("row").to_pylist(), batch.column("id").to_pylist(), enc.encode(data, at)):
                ids = np.append(ids, END_ID).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for p, (a, b) in enumerate(zip(edges, edges[1:])):
                    own = ids[a:b].tobytes()
                    rows.append((row, i, p, a, b - a, zlib.crc32(own), own if keep_ids else None))
            yield table(PIECE, *map(list, zip(*rows)))

    return docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, PIECE_SQL)


def place(cut: DataFrame, capacity: int) -> DataFrame:
    """``cut`` (any columns with row, piece and length) with sequence_id and offset.  Full pieces are sequences of their own."""
    part = cut.filter(F.col("length") < capacity)
    shards = max(1, math.ceil(part.count() / SHARD))

    def run(key, own):
        sequence, offset = pack(own.column("length").to_numpy(), capacity)
        return pa.table({"row": own.column("row"), "piece": own.column("piece"), "sequence_id": pa.array(sequence + key[0].as_py() * (1 << 20)), "offset": pa.array(offset)})

    placed = (
        part.select("row", "piece", "length", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).alias("shard"))
        .groupBy("shard").applyInArrow(run, "row long, piece int, sequence_id long, offset long")
    )
    full = cut.filter(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return part.join(placed, ["row", "piece"]).select(full.columns).union(full)


def packed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, tokenizer: str | None = None, store: Store | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of ``docs``.

    Null and empty texts are one piece, the end id.  Null or repeated ids are packed like others,
    as pieces belong to rows; other columns are not read; no rows give no pieces.
    """
    store = store or Store(docs.sparkSession)
    cut = store.put(cut_pieces(two_columns(docs, id_col, text_col), capacity, tokenizer or default_path(), False).drop("ids"), "pieces")
    return place(cut, capacity).select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, tokenizer: str | None = None) -> DataFrame:
    """(sequence_id, ids, doc_ids, lengths): the sequences themselves, ready to train on."""
    store = Store(docs.sparkSession)
    cut = store.put(cut_pieces(two_columns(docs, id_col, text_col), capacity, tokenizer or default_path(), True), "pieces")

    def run(key, own):
        own = own.sort_by("offset")
        ids = np.frombuffer(b"".join(own.column("ids").to_pylist()), "<u4").astype(np.int64)
        return pa.table({"sequence_id": pa.array([key[0].as_py()]), "ids": pa.array([ids], pa.list_(pa.int64())), "doc_ids": pa.array([own.column("id").to_pylist()], pa.list_(pa.int64())), "lengths": pa.array([own.column("length").to_pylist()], pa.list_(pa.int64()))})

    return place(cut, capacity).groupBy("sequence_id").applyInArrow(run, "sequence_id long, ids array<long>, doc_ids array<long>, lengths array<long>")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table in sequences of at most 1,024 tokens."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
