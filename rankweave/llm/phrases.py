"""Phrase collocations: n-gram counts from suffix arrays over word ids, and scores from their parts.

1. One scan cuts the documents into shards of about ``SHARD`` words.  Words get ids in their shard, a
   0 follows each piece of text that no phrase crosses, and prefix doubling sorts the suffixes by
   their first 4 ids.  Prefixes that neighbours in that order share give intervals, and an
   interval is an n-gram with its number and one of its places.
2. N-grams are dealt by a 64-bit hash of their words and language, and counts are merged by it: a
   shard sends each n-gram once, so a word or phrase of any frequency is at most one entry a shard.
3. Only frequent n-grams go on, each with one place; the texts meet those places once, and from
   there on everything is a small table of phrases, joined by phrase.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Store, pieces, table, with_row_key
from .graph import attach
from .words import LOWER, hashes, mix, spans

SHARD, SHARD_DOCS, PER_PART, SALTS = 1 << 20, 1 << 17, 1 << 20, 64
LONGEST = 3
_SPLIT = np.zeros(256, bool)  # bytes that end a piece, and bytes between words
_SPLIT[[10, 11, 12, 13, *b".,;:!?"]] = True
_WHITE = _SPLIT.copy()
_WHITE[[9, 32]] = True
_K = np.uint64(0x9FB21C651E98DF25)
COUNTS = pa.schema([("part", pa.int64()), ("n", pa.int32()), ("shard", pa.int64()), ("key", pa.binary()), ("count", pa.binary()), ("pos", pa.binary())])
COUNTS_SQL = "part long, n int, shard long, key binary, count binary, pos binary"
MERGED = pa.schema([("shard", pa.int64()), ("n", pa.int32()), ("key", pa.int64()), ("a", pa.int64()), ("pos", pa.int64())])
MERGED_SQL = "shard long, n int, key long, a long, pos long"
PLACED = pa.schema([("row", pa.int64()), ("n", pa.int32()), ("a", pa.int64()), ("at", pa.int64())])
FOUND = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("a", pa.int64())])


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, the texts' offsets among them, and which words are the last of their piece."""
    start, end, word_at = spans(data, at, _WHITE)
    splits = np.concatenate([[0], np.cumsum(_SPLIT[data])])
    last = np.ones(len(start), bool)
    last[:-1] = splits[start[1:]] > splits[end[:-1]]
    last[word_at[1:][word_at[1:] > 0] - 1] = True
    return start, end, word_at, last


def suffix_order(text: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Places of the suffixes of an array of ids, in the order of their first ``longest`` ids at least, by prefix doubling."""
    rank, k, order = text.astype(np.int64), 1, None
    while k < longest:
        pair = rank * (len(rank) + 2)  # ranks are at most the length
        pair[:-k] += rank[k:] + 1
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        rank[order] = np.cumsum(np.concatenate([[False], pair[1:] != pair[:-1]]))
        del pair
        k *= 2
    return np.argsort(text, kind="stable") if order is None else order


def ngram_counts(word: np.ndarray, last: np.ndarray, longest: int = LONGEST):
    """For n from 1 to ``longest``: places of one occurrence of each n-gram of hashed words, and how often it occurs; no n-gram goes over the ``last`` word of a piece."""
    place = (np.arange(len(word)) + np.concatenate([[0], np.cumsum(last)[:-1]])).astype(np.int32) if len(word) else np.zeros(0, np.int32)
    padded = np.zeros(len(word) + int(last.sum()) + longest, np.int32)  # a shard's words are fewer than 2**31
    padded[place] = np.unique(word, return_inverse=True)[1] + 1
    order = suffix_order(padded[: len(padded) - longest], longest).astype(np.int32)
    number = np.full(len(order), -1, np.int32)
    number[place] = np.arange(len(word))
    del place
    same = np.ones(max(len(order) - 1, 0), bool)
    whole = np.ones(len(order), bool)
    for n in range(1, longest + 1):
        own = padded[order + n - 1]
        same &= own[1:] == own[:-1]  # as many ids in common with the suffix before
        whole &= own > 0
        first = np.flatnonzero(np.concatenate([[True], ~same]) & whole) if len(order) else np.zeros(0, np.int64)
        bound = np.flatnonzero(np.concatenate([[True], ~same, [True]])) if len(order) else np.zeros(1, np.int64)
        yield n, number[order[first]], bound[np.searchsorted(bound, first, side="right")] - first


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary for each part of an array, without a copy of it."""
    at = np.concatenate([[0], ends]).astype(np.int64) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(values)])


def count(docs: DataFrame, parts: int) -> DataFrame:
    """N-grams of (row, lang_hash, text) by part, packed; parts below 0 tell the documents' places in the shards."""

    def run(batches):
        held, size, n_docs = [], 0, 0

        def out():
            row, n, word, last = (np.concatenate(c) for c in zip(*held))
            held.clear()
            shard = int(mix(row[:1].view(np.uint64) + np.uint64(len(row))).view(np.int64)[0])
            yield table(COUNTS, [-1 - shard % (1 << 12)], [0], [shard], *([c.astype(np.int64).tobytes()] for c in (row, n, np.cumsum(n) - n)))
            for k, pos, times in ngram_counts(word, last):
                key = np.full(len(pos), k, np.uint64)
                for j in range(k):
                    key = mix(key * _K + word[pos + j])
                part = (key % np.uint64(parts)).astype(np.int64)
                by = np.lexsort((key, part))
                part, cols = part[by], (key[by], times[by].astype(np.uint32), pos[by].astype(np.uint32))
                del key, by, times, pos
                cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
                ends = np.append(cut[1:], len(part))
                yield table(COUNTS, part[cut], np.full(len(cut), k), np.full(len(cut), shard), *(_packed(c, ends) for c in cols))

        for batch, data, at in pieces(batches):
            start, end, word_at, last = words_of(data, at)
            n = np.diff(word_at)
            lang = np.repeat(batch.column("lang_hash").to_numpy().view(np.uint64), n)
            held.append((batch.column("row").to_numpy(), n, mix(hashes(data, start, end) ^ lang), last))
            size, n_docs = size + len(start), n_docs + len(n)
            if size >= SHARD or n_docs >= SHARD_DOCS:
                yield from out()
                held, size, n_docs = [], 0, 0
        if held:
            yield from out()

    return docs.select("row", "lang_hash", "text").mapInArrow(run, COUNTS_SQL)


def merge(counts: DataFrame, least: int) -> DataFrame:
    """(shard, n, key, a, pos): n-grams that occur ``least`` times or more in all, with one place; with n = 0 the documents: key is the row, a its words, pos its first."""

    def run(part, got):
        read = lambda c, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in got.column(c))])
        narrow = part[0].as_py() >= 0
        key, times, pos = read("key", "i8"), read("count", "u4" if narrow else "i8").astype(np.int64), read("pos", "u4" if narrow else "i8").astype(np.int64)
        sizes = np.array([len(x.as_buffer()) // 8 for x in got.column("key")])
        n, shard = (np.repeat(got.column(c).to_numpy(), sizes) for c in ("n", "shard"))
        if narrow:  # the hash holds n
            by = np.argsort(key, kind="stable")
            new = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))
            total = np.add.reduceat(times[by], new)
            some = by[new[total >= least]]
            key, pos, n, shard, times = key[some], pos[some], n[some], shard[some], total[total >= least]
        return pa.table([shard, n.astype(np.int32), key, times, pos], schema=MERGED)

    return counts.groupBy("part").applyInArrow(run, MERGED_SQL)


def texts_of(docs: DataFrame, merged: DataFrame) -> DataFrame:
    """(lang, words, a) of the merged n-grams."""

    def place(found, documents):
        first = documents.column("pos").to_numpy()
        by = np.argsort(first, kind="stable")
        pos = found.column("pos").to_numpy()
        at = np.searchsorted(first[by], pos, side="right") - 1  # of documents without words that share a place the last, which has them
        return pa.table([documents.column("key").to_numpy()[by[at]], found.column("n"), found.column("a"), pos - first[by[at]]], schema=PLACED)

    grams, documents = merged.filter("n > 0").groupBy("shard"), merged.filter("n = 0").groupBy("shard")
    placed = grams.cogroup(documents).applyInArrow(place, "row long, n int, a long, at long")
    lists = placed.groupBy("row").agg(F.collect_list(F.struct("n", "a", "at")).alias("grams"))

    def run(batches):
        for batch, data, at in pieces(batches):
            start, end, word_at, _ = words_of(data, at)
            low, grams = LOWER[data].tobytes(), batch.column("grams")
            size = grams.value_lengths().to_numpy()
            n, a, first = (grams.flatten().field(k).to_numpy() for k in range(3))
            first = first + np.repeat(word_at[:-1], size)
            words = [[low[start[x] : end[x]].decode() for x in range(i, i + k)] for i, k in zip(first.tolist(), n.tolist())]
            yield table(FOUND, batch.column("lang").take(pa.array(np.repeat(np.arange(len(size)), size))), words, a)

    return docs.join(lists, "row").select("lang", "text", "grams").mapInArrow(run, "lang string, words array<string>, a long")


def collocations(
    docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", least: int = 10, inside: int = 50, top: int = 2000
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two or three words of each language.

    A null language is ``und``, a null text is empty; a language without phrases gives no row.  Ids are
    not read, so repeated rows count as often as they are there.  A phrase inside a longer one that
    has ``inside`` per cent of its occurrences is left out.
    """
    store = Store(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    docs, key = with_row_key(docs, store)
    docs = docs.withColumnRenamed(key, "row").withColumn("lang_hash", F.xxhash64("lang"))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    merged = store.put(merge(count(docs, 1 + n_bytes // 3 // PER_PART), least), "merged")  # about six bytes a word, two n-grams
    key_of = lambda words: F.concat(F.length("lang").cast("string"), F.lit(":"), "lang", F.array_join(words, " "))  # noqa: E731 (one key for one language and phrase, whatever characters they hold)
    grams = store.put(texts_of(docs, merged).select("lang", "words", "a", key_of("words").alias("name")), "grams")
    total = merged.filter("n = 0").select(F.col("key").alias("row"), "a").join(docs.select("row", "lang"), "row").groupBy("lang").agg(F.sum("a").alias("n"))

    part = lambda a, n: key_of(F.slice("words", a, n))
    long = grams.filter(F.size("words") > 1)
    cuts = store.put(long.select("lang", "words", "name", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")).select("lang", "name", "a", "k", part(1, F.col("k")).alias("left"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("right")), "cuts")
    n_cuts = cuts.count()
    for side, number in (("left", "l"), ("right", "r")):
        uses = cuts.groupBy(side).agg(F.count("*").alias("uses"))
        cuts = attach(store, cuts, uses.join(grams.select(F.col("name").alias(side), F.col("a").alias(number)), side), side, "uses", n_cuts)
    big = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = cuts.withColumn("one", F.lit(1_000_000).cast("decimal(8,0)")).withColumn("over", big("a") * big("a")).withColumn("under", big("l") * big("r")).withColumn("score", F.expr("(one * over) div under"))
    scored = cuts.groupBy("lang", "name", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = long.select("a", "lang", "words", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("m")).filter("m < size(words)")
    longer = longer.select("a", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("m") + 1), lambda i: part(i, F.col("m")))).alias("name")).groupBy("name").agg(F.max("a").alias("most"))
    kept = scored.join(longer, "name", "left").filter(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * inside))
    kept = kept.select("lang", F.expr("substring(name, length(cast(length(lang) as string)) + length(lang) + 2)").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for keys in (("lang", "salt"), ("lang",)):
        kept = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
    return kept.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language of the whole ``documents`` table."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
