"""Corpus language model by deleted interpolation, and the log-probability of every text.

p(w | v) = l2(b) c(v,w)/c(v) + l1(b) c(w)/N + l0(b) / (V + 1), where b is the bucket of c(v): how
often the context was seen, in powers of two.  Weights are learned by expectation-maximisation
on a fold of the training documents from counts that leave that fold out; the final counts are
those of all training documents.

Counting moves n-grams, not tokens: a block of neighbouring documents has each distinct unigram
and bigram once, as a sorted array of 64-bit hashes cut into ranges, one range a reducer.  The
reducer returns counts in the order of the hashes, so the way back carries numbers only, and a
very common n-gram is one entry a block like any other.  Then each block's texts meet its
counts.  Where a block's rows lie in two splits of a file, each part of it has counts of its own, with
the row that it starts at, and texts find theirs by their rows; how files are split may change
between the two.  A block has a row for each range that it has n-grams of, so at most one an n-gram,
however many ranges a larger corpus has; a text of ``LONE`` bytes or more is a block of its own,
so a block's size is bounded in bytes too.  Nothing of the corpus reaches the driver but totals
and a histogram of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import Store, fold, release, table, two_columns, utf8

#: Rows of a block, bytes of a text that is a block of its own, text bytes a reducer's share, buckets of context frequency, histogram steps an octave.
BLOCK_ROWS, LONE, SHARE, BUCKETS, STEPS = 1024, 1 << 17, 8 << 20, 24, 8
_END, _START = np.uint64(0x5DEECE66D1234567), np.uint64(0x2545F4914F6CDD1D)
_ONE = np.uint64(1)
GRAMS = pa.schema([("block", pa.int64()), ("first", pa.int64()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("main", pa.binary()), ("fold", pa.binary())])
COUNTS_SQL = "block long, first long, bucket int, main binary, every binary, n_main long, n_every long, v_main long, v_every long"
SCORES_SQL = "id long, n_tokens long, n_known long, base_score double, score double"


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words and of the end of each text, of the bigrams that end there, and the texts' offsets.

    The lowest bit tells unigrams (1) from bigrams (0).
    """
    start, end, word_at = W.spans(data, at)
    n = len(at) - 1
    offsets = word_at + np.arange(n + 1)
    own = np.empty(offsets[-1], np.uint64)
    last = np.zeros(len(own), bool)
    last[offsets[1:] - 1] = True
    own[last], own[~last] = _END, W.hashes(data, start, end)
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[offsets[:-1]] = _START
    return own | _ONE, W.mix(before * np.uint64(0xD6E8FEB86659FD93) + own) & ~_ONE, offsets


def located(docs: DataFrame, store: Store) -> DataFrame:
    """``docs`` (id, text) with ``place`` in the file and ``block``: rows that lie together in a file, long texts alone; input that is no scan of files is written first."""
    try:
        place = docs.metadataColumn("_metadata")
    except AnalysisException:
        docs = store.put(docs, "docs")
        place = docs.metadataColumn("_metadata")
    run = F.xxhash64(place["file_path"], F.floor(place["row_index"] / BLOCK_ROWS))
    alone = F.xxhash64(place["file_path"], place["row_index"], F.lit("alone"))
    block = F.when(F.octet_length("text") >= LONE, alone).otherwise(run)
    return docs.select("*", block.bitwiseAND(F.lit(-4)).alias("block"), place["row_index"].alias("place"))


def _count_grams(batches, bits):
    """Rows of GRAMS for each block; blocks are runs of rows, across batches, but for long texts amid them."""

    def flush(block, first, held):
        for group in sorted({g for g, *_ in held}):
            own = [x for g, *x in held if g == group]
            data = np.concatenate([d for d, _ in own])
            at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(a) for _, a in own]))])
            one, two, _ = tokens(data, at)
            grams, n = np.unique(np.concatenate([one, two]), return_counts=True)
            ranges = (grams >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), np.int64)
            cuts = np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1])) if len(grams) else np.zeros(0, np.int64)
            n = n.astype(np.int32)
            none = np.zeros_like(n)
            main, fold_ = (n, none) if group == 0 else (none, n) if group == 1 else (none, none)
            rows = [(block + group, first, int(ranges[a]), grams[a:b].tobytes(), main[a:b].tobytes(), fold_[a:b].tobytes()) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(grams)])]
            yield table(GRAMS, *map(list, zip(*rows)))

    last, first, held = None, 0, []
    for batch in batches:
        data, at = utf8(batch.column("text"))
        place = batch.column("place").to_numpy()
        block, group = batch.column("block").to_numpy(), batch.column("part").to_numpy()
        long = np.diff(at) >= LONE
        for i in np.flatnonzero(long).tolist():
            yield from flush(int(block[i]), int(place[i]), [(int(group[i]), data[at[i] : at[i + 1]], at[i : i + 2] - at[i])])
        rest = np.flatnonzero(~long)
        edges = np.flatnonzero(np.append(True, block[rest][1:] != block[rest][:-1])) if len(rest) else np.zeros(0, np.int64)
        for own in np.split(rest, edges[1:]) if len(rest) else []:
            if block[own[0]] != last:
                if last is not None:
                    yield from flush(last, first, held)
                held, last, first = [], int(block[own[0]]), int(place[own[0]])
            for g in np.unique(group[own]).tolist():
                pick = own[group[own] == g]
                held.append((g, np.concatenate([data[at[i] : at[i + 1]] for i in pick]), np.concatenate([[0], np.cumsum(at[pick + 1] - at[pick])])))
    if last is not None:
        yield from flush(last, first, held)
    held.clear()
    release()


def _reduce(key, own):
    """Counts over all blocks of one range of hashes, in the order of each block's hashes, and a row of totals."""
    raw = own.column("hashes").combine_chunks()
    grams = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in raw])
    sizes = np.array([x.as_buffer().size // 8 for x in raw])
    read = lambda c: np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in own.column(c).combine_chunks()])
    types, where = np.unique(grams, return_inverse=True)
    main = np.bincount(where, read("main"), len(types)).astype(np.int64)
    every = main + np.bincount(where, read("fold"), len(types)).astype(np.int64)
    word = types & _ONE == 1
    totals = [int(x[word].sum()) for x in (main, every)] + [int((x[word] > 0).sum()) for x in (main, every)]
    ends = np.cumsum(sizes)
    cut = lambda x: [x[a:b].tobytes() for a, b in zip(ends - sizes, ends)]
    none = [0] * len(sizes)
    return pa.table({
        **{c: pa.array([*own.column(c).to_pylist(), None], pa.int64()) for c in ("block", "first")}, "bucket": pa.array([key[0].as_py()] * (len(sizes) + 1), pa.int32()),
        "main": pa.array([*cut(main[where].astype(np.uint32)), None], pa.binary()), "every": pa.array([*cut(every[where].astype(np.uint32)), None], pa.binary()),
        **{n: pa.array([*none, t], pa.int64()) for n, t in zip(("n_main", "n_every", "v_main", "v_every"), totals)},
    })


def _looked_up(texts: pa.Table, counts: pa.Table, column: str):
    """The block's texts by place, c(w), c(v,w) and c(v) of every token of them, and the texts' offsets."""
    texts = texts.sort_by("place")
    counts = counts.sort_by([("first", "ascending"), ("bucket", "ascending")])
    firsts, rows = np.unique(counts.column("first").to_numpy(), return_index=True)
    cuts = [0, *np.searchsorted(texts.column("place").to_numpy(), firsts[1:]).tolist(), texts.num_rows]
    found = []
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):  # as many as splits of the file cut the block
        data, at = utf8(texts.column("text").slice(a, b - a))
        one, two, offsets = tokens(data, at)
        _, where = np.unique(np.concatenate([one, two]), return_inverse=True)
        own = counts.column(column).slice(rows[k], (rows[k + 1] if k + 1 < len(rows) else counts.num_rows) - rows[k])
        c = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in own]).astype(np.int64)[where]
        cw, cvw = c[: len(one)], c[len(one) :]
        cv = np.empty_like(cw)
        cv[1:] = cw[:-1]
        cv[offsets[:-1]] = cw[offsets[1:] - 1]  # texts start as often as they end
        found.append((cw, cvw, cv, np.diff(offsets)))
    cw, cvw, cv, n = map(np.concatenate, zip(*found))
    return texts, cw, cvw, cv, np.concatenate([[0], np.cumsum(n)])


def _bucket(cv: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(cv > 0, np.log2(np.maximum(cv, 1)).astype(np.int64) + 1, 0), BUCKETS - 1)


def weights(cells: np.ndarray, n: np.ndarray, v_main: int, rounds: int = 60) -> np.ndarray:
    """EM: BUCKETS x 3 weights (bigram, unigram, uniform) from histogram cells (bucket, step of p2, step of p1; -1 for 0)."""
    out = np.tile([0.3, 0.6, 0.1], (BUCKETS, 1))
    out[0] = 0, 0.85, 0.15
    if not len(n):
        return out
    b, q2, q1 = cells.T
    p = np.column_stack([np.where(q2 < 0, 0, 2.0 ** (-q2 / STEPS)), np.where(q1 < 0, 0, 2.0 ** (-q1 / STEPS)), np.full(len(n), 1 / (v_main + 1))])
    for _ in range(rounds):
        post = p * out[b]
        post *= (n / post.sum(axis=1))[:, None]
        out = np.column_stack([np.bincount(b, post[:, k], BUCKETS) for k in range(3)]) + [[0.1, 0.2, 0.1]]  # a bucket without events keeps a prior
        out[0, 0] = 0  # an unseen context says nothing of the next word
        out /= out.sum(axis=1, keepdims=True)
    return out


def language_scores(docs: DataFrame, held_out, deleted, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score, train_tokens) of every row.

    ``held_out`` and ``deleted`` are conditions on ``id``: rows not to learn from, and the rows of the
    rest on which the weights are learned.  Null counts as empty (its end is one token); a null id
    is learned from like any row that ``held_out`` does not hold of; ids may repeat; other columns
    are not read.  Without training rows every probability is 1 / (V + 1) = 1.
    """
    spark = docs.sparkSession
    store = Store(spark)
    part = F.when(F.coalesce(held_out, F.lit(False)), 2).when(F.coalesce(deleted, F.lit(False)), 1).otherwise(0)
    docs = located(two_columns(docs, id_col, text_col), store)
    docs = docs.withColumn("part", part)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, size / SHARE))))
    grams = docs.mapInArrow(lambda it: _count_grams(it, bits), "block long, first long, bucket int, hashes binary, main binary, fold binary")
    counts = store.put(grams.groupBy("bucket").applyInArrow(_reduce, COUNTS_SQL), "counts")
    n_main, n_every, v_main, v_every = (x or 0 for x in counts.filter("block is null").agg(*(F.sum(c) for c in ("n_main", "n_every", "v_main", "v_every"))).first())
    keyed = docs.withColumn("block", F.col("block") + F.col("part"))
    back = counts.filter("block is not null")

    def histogram(texts, own):
        if not texts.num_rows:
            return pa.table({"cell": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        _, cw, cvw, cv, _ = _looked_up(texts, own, "main")
        step = lambda num, den: np.where(num > 0, np.minimum(np.round(-STEPS * np.log2(np.maximum(num, 1) / np.maximum(den, 1))), 255), 256).astype(np.int64)
        cell, n = np.unique((_bucket(cv) << 18) | (step(cvw, cv) << 9) | step(cw, np.full_like(cw, n_main)), return_counts=True)
        return pa.table({"cell": pa.array(cell, pa.int64()), "n": pa.array(n, pa.int64())})

    fold_only = lambda df: df.filter(F.col("block").bitwiseAND(F.lit(3)) == 1).groupBy("block")
    cells = fold_only(keyed.filter("part = 1").select("block", "place", "text")).cogroup(fold_only(back.select("block", "first", "bucket", "main"))).applyInArrow(histogram, "cell long, n long")
    got = sorted((r.cell, r.n) for r in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect())  # BUCKETS * 257 ** 2 cells at most, whatever the data
    cell = np.array([c for c, _ in got], np.int64)
    place = lambda x: np.where(x == 256, -1, x)
    mixture = weights(np.column_stack([cell >> 18, place((cell >> 9) & 511), place(cell & 511)]), np.array([n for _, n in got], float), v_main)

    def score(texts, own):
        if not texts.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})
        texts, cw, cvw, cv, offsets = _looked_up(texts, own, "every")
        lam = mixture[_bucket(cv)]
        p = lam[:, 0] * cvw / np.maximum(cv, 1) + lam[:, 1] * cw / max(n_every, 1) + lam[:, 2] / (v_every + 1)
        if not n_every:
            p[:] = 1 / (v_every + 1)
        add = lambda x: np.add.reduceat(x, offsets[:-1])
        return pa.table({
            "id": texts.column("id"), "n_tokens": pa.array(np.diff(offsets)), "n_known": pa.array(add((cw > 0).astype(np.int64))),
            "base_score": pa.array(add(np.log10((cw + 1) / (n_every + v_every + 1)))), "score": pa.array(add(np.log10(p))),
        })

    scored = keyed.select("block", "place", "id", "text").groupBy("block").cogroup(back.select("block", "first", "bucket", "every").groupBy("block")).applyInArrow(score, SCORES_SQL)
    return scored.withColumn("train_tokens", F.lit(n_every).cast("long"))


def op5_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the whole ``documents`` table, learned from all rows outside fold 2 of 7, the weights on fold 3."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_scores(docs, fold("id", 7) == 2, fold("id", 7) == 3)
    return got.select(F.col("id").alias("doc_id"), (fold("id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
