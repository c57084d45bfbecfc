"""Passages that documents share, byte by byte: suffix arrays over shards of text that may repeat.

A byte goes if a string of ``size`` bytes over it also starts in a document of a smaller id.  Every
such string is sent where its equals are by a function of the string alone: of its q-grams the one
with the smallest hash is its anchor.  Neighbouring strings with one anchor are one context, the
bytes from the first's start to the last's end.

1. One scan makes contexts, equal ones of a slice of text counted once, and deals their hashes, not
   their text, to shards by anchor.  In a shard, of equal contexts those of the smallest id stay
   and the others go; anchors under which contexts of different ids stay are open.
2. Only open contexts, a small part of the text, are cut from the documents.  Shards of them get
   a suffix array by induced sorting and permuted common prefixes; suffixes with ``size`` bytes in
   common are a class, and those of larger ids than the smallest of their class go.
3. An anchor with over ``MEET`` open contexts is too much for a shard: its contexts are dealt anew by
   longer q-grams, up to whole strings, where equal anchors mean equal contexts.

So no shard grows with a group of copies, and every pair of equal strings meets or is known equal.
Intermediate tables go to ``spark.checkpoint.dir``; texts move once to be cut and once to be digested.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store, pieces, release, table, with_row_key
from .suffix import _eights, common_prefixes, suffix_array
from .words import mix

SIZE = 50
#: Lengths of the anchors' q-grams, one after the other for anchors with over MEET open contexts.
GRAMS = (20, 35, SIZE)
MEET = 4096
#: Contexts that a task combines at once, contexts and bytes of open contexts of a shard.
COMBINE, PER_SHARD, SHARD_BYTES = 1 << 18, 1 << 19, 2 << 20
#: Contexts or bytes of a group after which a worker gives freed memory back.
LARGE = 1 << 18
_K = np.uint64(0x9FB21C651E98DF25)
DEALT = pa.schema([("shard", pa.int64()), ("key", pa.binary()), ("whole", pa.binary()), ("id", pa.binary()), ("pid", pa.binary()), ("a", pa.binary()), ("n", pa.binary())])
DEALT_SQL = "shard long, key binary, whole binary, id binary, pid binary, a binary, n binary"
KINDS = ("u4", "u8", "i8", "i8", "i8", "u1")
JUDGED = pa.schema([("pid", pa.int64()), ("a", pa.int64()), ("n", pa.int32()), ("key", pa.int64()), ("kind", pa.int8())])
GONE, OPEN, HOT = 0, 1, 2
CUT = pa.schema([("part", pa.int64()), ("pid", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("base", pa.int64()), ("text", pa.binary()), ("hot", pa.bool_())])
CUT_SQL = "part long, pid long, row long, id long, base long, text binary, hot boolean"
COVER = pa.schema([("row", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
RESULT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])
RESULT_SQL = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"


def contexts(data: np.ndarray, at: np.ndarray, q: int, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last start of each context, and the place of its anchor; a string belongs to one context and no context leaves its text."""
    n = len(data)
    if n < size:
        return (np.zeros(0, np.int64),) * 3
    eight = _eights(data)
    rank = (eight[(q - 8) // 2 :][: n - q + 1] * _K) >> np.uint64(32)
    best = (rank << np.uint64(32)) | np.arange(n - q + 1, dtype=np.uint64)
    left, width = size - q + 1, 1
    while width < left:
        step = min(width, left - width)
        best = np.minimum(best[: len(best) - step], best[step:])
        width += step
    anchor = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    crossing = np.zeros(n + 1, np.int32)  # starts whose string would leave their text
    np.add.at(crossing, np.maximum(at[:-1], at[1:] - size + 1), 1)
    np.add.at(crossing, at[1:], -1)
    inside = np.cumsum(crossing[: n - size + 1]) == 0
    change = anchor[1:] != anchor[:-1]
    first = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1] | change]))
    last = np.flatnonzero(inside & np.concatenate([~inside[1:] | change, [True]]))
    return first, last, anchor[first]


def _hashed(eight: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of the bytes from each start on; lengths are 8 or more."""
    h = np.zeros(len(start), np.uint64) + np.asarray(length).astype(np.uint64)
    most = int(np.max(length)) if len(start) else 0
    for k in range(0, most, 8):
        step = mix(h * _K + eight[start + np.minimum(k, length - 8)])
        h = step if np.isscalar(length) else np.where(k < length, step, h)
    return h


def _combined(cols: list[np.ndarray]) -> np.ndarray:
    """Which rows of (key, whole, id, ...) have the smallest id of their (key, whole)."""
    key, whole, own = cols[:3]
    by = np.lexsort((own, whole, key))
    new = np.concatenate([[True], (key[by][1:] != key[by][:-1]) | (whole[by][1:] != whole[by][:-1])]) if len(by) else np.zeros(0, bool)
    least = np.repeat(own[by][new], np.diff(np.append(np.flatnonzero(new), len(by))))
    keep = np.zeros(len(by), bool)
    keep[by] = own[by] == least
    return keep


def deal(texts: DataFrame, q: int, shards: int, size: int = SIZE) -> DataFrame:
    """Contexts of (pid, id, text) by shard, packed; shard -1 has those that go already."""

    def run(batches):
        held, n = [], 0

        def out():
            shard, *cols = (np.concatenate(c) for c in zip(*held))
            keep = _combined([shard, *cols][1:4])
            by = np.argsort(np.where(keep, shard, -1), kind="stable")
            shard, cols = np.where(keep, shard, -1)[by], [c[by] for c in cols]
            cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            packed = [[c[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(shard)))] for c in cols]
            yield table(DEALT, shard[cut], *packed)

        for batch, data, at in pieces(batches, size=1 << 20):
            first, last, anchor = contexts(data, at, q, size)
            eight = _eights(data)
            key = _hashed(eight, anchor, q)
            which = np.searchsorted(at, first, side="right") - 1
            pid, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("pid", "id"))
            shard = ((key >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
            held.append((shard, key.astype(np.uint32), _hashed(eight, first, last - first + size), own[which], pid[which], first - at[which], (last - first + 1).astype(np.uint8)))
            n += len(first)
            if n >= COMBINE:
                yield from out()
                held, n = [], 0
        if n:
            yield from out()

    return texts.select("pid", "id", "text").mapInArrow(run, DEALT_SQL)


def judge(dealt: DataFrame, last: bool) -> DataFrame:
    """(pid, a, n, key, kind): of each shard's contexts those that go, and those under open anchors; ``last`` is of whole strings, where none is open."""

    def run(part, got):
        key, whole, own, pid, a, n = (np.frombuffer(b"".join(got.column(c).to_pylist()), k) for c, k in zip(DEALT.names[1:], KINDS))
        number = part[0].as_py()
        kind = np.full(len(key), GONE, np.int8)
        if number >= 0:
            kept = np.flatnonzero(_combined([key, whole, own]))
            by = kept[np.lexsort((own[kept], key[kept]))]
            new = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))
            end = np.append(new[1:], len(by))
            is_open = own[by][new] != own[by][end - 1]
            kind[by] = np.repeat(np.where(is_open, np.where((end - new > MEET) & (not last), HOT, OPEN), -1), end - new)
        some = np.flatnonzero(kind >= 0)
        if len(key) > LARGE:
            release()
        return pa.table([pid[some], a[some], n[some].astype(np.int32), (key[some].astype(np.int64) << 24) ^ number, kind[some]], schema=JUDGED)

    part = F.when(F.col("shard") < 0, -1 - F.pmod(F.xxhash64("a"), F.lit(1 << 12))).otherwise(F.col("shard"))
    return dealt.withColumn("part", part).groupBy("part").applyInArrow(run, "pid long, a long, n int, key long, kind byte")


def cut(texts: DataFrame, judged: DataFrame, parts: int, size: int = SIZE) -> DataFrame:
    """The open contexts with their text, by shard of what is sorted together."""
    lists = judged.filter(F.col("kind") != GONE).groupBy("pid").agg(F.collect_list(F.struct("a", "n", "key", "kind")).alias("cuts"))

    def run(batches):
        for batch, data, at in pieces(batches):
            cuts = batch.column("cuts")
            count = cuts.value_lengths().to_numpy()
            a, n, key, kind = (cuts.flatten().field(k).to_numpy() for k in range(4))
            which = np.repeat(np.arange(len(count)), count)
            row, own, base = (batch.column(c).to_numpy()[which] for c in ("row", "id", "base"))
            start = at[which] + a
            raw = data.tobytes()
            text = [raw[x:y] for x, y in zip(start.tolist(), (start + n + size - 1).tolist())]
            pid = mix(mix(row.view(np.uint64)) ^ (base + a).astype(np.uint64)).view(np.int64)
            part = (mix(key.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            yield table(CUT, part, pid, row, own, base + a, text, kind == HOT)

    return texts.join(lists, "pid").select("row", "id", "base", "text", "cuts").mapInArrow(run, CUT_SQL)


def covered(cuts: DataFrame, size: int = SIZE) -> DataFrame:
    """(row, start, end): bytes over strings that also start in a text of a smaller id, by a suffix array of each part."""

    def run(got):
        text = got.column("text").to_pylist()
        length = np.array([len(t) for t in text], np.int64)
        data = np.frombuffer(b"\xff".join(text), np.uint8)  # no byte of UTF-8
        begin = np.cumsum(np.append(0, length[:-1] + 1))
        order = suffix_array(data)
        shared = common_prefixes(data, order)[order]
        which = np.searchsorted(begin, order, side="right") - 1
        fits = order + size <= begin[which] + length[which]
        own = got.column("id").to_numpy()[which]
        new = np.flatnonzero(shared < size)  # intervals of suffixes with so many bytes in common
        least = np.repeat(np.minimum.reduceat(own, new), np.diff(np.append(new, len(own))))
        gone = np.zeros(len(data) + 1, bool)
        gone[order[fits & (own > least)]] = True
        edge = np.diff(np.concatenate([[False], gone]).astype(np.int8))
        first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        which = np.searchsorted(begin, first, side="right") - 1
        move = got.column("base").to_numpy()[which] - begin[which]
        if len(data) > LARGE:
            del text, data, order, shared, fits, own, least, gone, edge
            release()
        return pa.table([got.column("row").to_numpy()[which], first + move, end + move + size - 1], schema=COVER)

    return cuts.groupBy("part").applyInArrow(run, "row long, start long, end long")


def repeated(texts: DataFrame, store: Store, size: int = SIZE, grams: tuple[int, ...] = GRAMS) -> DataFrame:
    """(row, start, end) of all bytes to go, in pieces that may overlap, of texts (pid, row, id, base, text) with no null id."""
    q, n_bytes = grams[0], texts.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    judged = store.put(judge(deal(texts, q, 1 + int(n_bytes * 2 / (size - q + 2)) // PER_SHARD, size), len(grams) == 1), "judged")
    found = judged.filter(F.col("kind") == GONE).join(texts.select("pid", "row", "base"), "pid").select("row", (F.col("base") + F.col("a")).alias("start"), (F.col("base") + F.col("a") + F.col("n") + size - 1).alias("end"))
    open_bytes = judged.filter(F.col("kind") == OPEN).agg(F.sum(F.col("n") + size)).head()[0] or 0
    cuts = store.put(cut(texts, judged, 1 + open_bytes // SHARD_BYTES, size), "cuts")
    found = found.union(store.put(covered(cuts.filter("not hot"), size), "covered"))
    hot = cuts.filter("hot")
    return found if hot.isEmpty() else found.union(repeated(hot, store, size, grams[1:]))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """One row per row of ``docs``: (id, n_bytes, n_removed, n_spans, kept_sha256, spans), spans as start, end, start, end ... of what is removed.

    A null text is empty.  A row without an id loses nothing and takes nothing from others; rows of
    one id take nothing from each other.  Texts below ``size`` bytes lose nothing.  Other columns
    are not read.
    """
    store = Store(docs.sparkSession)
    keyed, key = with_row_key(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text")), store)
    texts = keyed.select(F.col(key).alias("pid"), F.col(key).alias("row"), "id", F.lit(0).cast("long").alias("base"), "text")
    found = repeated(texts.filter("id is not null"), store, size).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("covers"))

    def run(batches):
        for batch, data, at in pieces(batches):
            rows = []
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                own, spans = data[a:b], np.zeros(0, np.int64)
                covers = batch.column("covers")[i]
                if covers.is_valid:
                    edge = np.zeros(b - a + 1, np.int32)
                    start, end = (covers.values.field(k).to_numpy() for k in (0, 1))
                    np.add.at(edge, start, 1)
                    np.add.at(edge, end, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    spans = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    own = own[~gone]
                rows.append((b - a, b - a - len(own), len(spans) // 2, hashlib.sha256(own.tobytes()).hexdigest(), spans.tolist()))
            yield table(RESULT, batch.column("id"), *map(list, zip(*rows)))

    return texts.select("row", "id", "text").join(found, "row", "left").select("id", "text", "covers").mapInArrow(run, RESULT_SQL)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all whole texts of ``documents`` that a document of a smaller id has too, in strings of 50."""
    found = deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
