"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Circulant MinHash (Li and Li, 2021) draws two permutations of a universe of ``2**universe_bits``
slots: the first scatters a document's shingles over the slots, the second gives each slot a
rank, and coordinate k of the signature is the smallest rank after shifting the second
permutation circularly by k.  A slot's ranks under all shifts are neighbours in memory, so a
signature is one contiguous slice per shingle and a running minimum.

Steps, each linear in the documents and in the candidate links:

1. One scan gives each document its number of shingles, a 128-bit fingerprint of its whole
   shingle set, and band keys.  No text or set is kept.
2. Documents with one fingerprint are one class; only classes go on, so a group of copies of
   any size is a single member from here.
3. Classes that share a band key form a bucket.  Each member is verified (full sets, integer
   test) against the bucket's hub, the class that meets most others over all buckets, which
   in a group of near copies is their original; verified links give components.
4. Buckets whose members still lie in several components are finished exactly: two linked sets
   share one of the rarest fifth of their shingles (prefix filter), so the members of such
   buckets meet by those shingles, never bucket by bucket, as passages that many documents
   share are not among the rarest; of the smaller set the rarest ninth and one more will do, so
   neither do pages of one template meet.  Pairs of different components whose sizes and places
   allow a link are verified.

So every pair that shares a bucket is verified, already linked through others, or ruled out by
a bound.  With 24 bands of 4 rows a pair of similarity 0.8 shares no bucket with probability 3e-6.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import Store, pieces, release, table, two_columns, with_row_key
from .graph import attach, components, shuffled

SIGS = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("ck", pa.binary()), ("bands", pa.list_(pa.int64()))])
SETS = pa.schema([("ck", pa.binary()), ("n", pa.int64()), ("hashes", pa.binary())])
EDGES = pa.schema([("a", pa.binary()), ("b", pa.binary())])
RARE = pa.schema([("h", pa.int64()), ("ck", pa.binary()), ("comp", pa.binary()), ("n", pa.int64()), ("at", pa.int32())])
#: Members of one leader that one streaming group verifies, rows that meet in one task on one shingle, counters of shingle frequencies.
SALT_ROWS, MEET_ROWS, COUNTERS = 64, 1024, 1 << 20


@cache
def permutations(bits: int, shifts: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and windows of the second one: row s has the ranks of slot s under all shifts."""
    rng = np.random.default_rng(seed)
    scatter = rng.permutation(1 << bits).astype(np.int32)
    ranks = rng.permutation(1 << bits).astype(np.int32)
    return scatter, np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[: shifts - 1]]), shifts)


def signature(hashes: np.ndarray, bits: int, shifts: int, seed: int) -> np.ndarray:
    """Circulant MinHash of a non-empty set of 64-bit hashes."""
    scatter, windows = permutations(bits, shifts, seed)
    slots = scatter[(hashes >> np.uint64(64 - bits)).astype(np.int64)]
    step = max(1, (1 << 18) // shifts)
    best = windows[slots[:step]].min(axis=0)
    for i in range(step, len(slots), step):
        np.minimum(best, windows[slots[i : i + step]].min(axis=0), out=best)
    return best


def band_keys(best: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` coordinates, of the band's number too."""
    part = best.reshape(-1, rows).astype(np.uint64)
    key = np.arange(len(part), dtype=np.uint64)
    for j in range(rows):
        key = W.mix(key * np.uint64(0x9FB21C651E98DF25) + part[:, j])
    return key.view(np.int64)


def _sets(batches, k):
    for batch, data, at in pieces(batches):
        start, end, word_at = W.spans(data, at)
        yield batch, W.shingles(W.hashes(data, start, end), word_at, k)


def _fingerprint(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, k: int, bands: int, rows: int, bits: int, seed: int) -> DataFrame:
    """(id, row, n, ck, bands): size and fingerprint of the shingle set, and band keys; ck and bands are null for an empty set."""

    def run(batches):
        for batch, sets in _sets(batches, k):
            yield table(
                SIGS, batch.column("id"), batch.column("row"), [len(s) for s in sets], [_fingerprint(s) if len(s) else None for s in sets],
                [band_keys(signature(s, bits, bands * rows, seed), rows) if len(s) else None for s in sets],
            )

    return docs.mapInArrow(run, "id long, row long, n long, ck binary, bands array<long>")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(ck, n, hashes): the sorted 64-bit hashes of the shingle set of each document (text, ck) whose fingerprint is ``ck``."""

    def run(batches):
        for batch, sets in _sets(batches, k):
            own = [(c, s) for c, s in zip(batch.column("ck").to_pylist(), sets) if _fingerprint(s) == c]
            yield table(SETS, [c for c, _ in own], [len(s) for _, s in own], [s.tobytes() for _, s in own])

    return docs.select("text", "ck").mapInArrow(run, "ck binary, n long, hashes binary")


def _slot(hashes: np.ndarray, counters: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - counters.bit_length() + 1)).astype(np.int64)


def frequencies(sets: DataFrame, counters: int) -> np.ndarray:
    """How many of the sets' shingles fall on each of so many counters (a power of two): an order of shingles from rare to common, of fixed size."""

    def run(batches):
        total = np.zeros(counters, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_slot(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("hashes")]), counters), minlength=counters)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(some, pa.int32()), "n": pa.array(total[some], pa.int64())})

    got = sets.select("hashes").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # so many rows at most
    out = np.zeros(counters, np.int64)
    out[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return out


def rarest(sets: DataFrame, num: int, den: int, counters: int = COUNTERS) -> DataFrame:
    """(h, ck, comp, n, at): the ``n - need + 1`` rarest shingles of each set, ``need`` being the fewest that it shares with a set it links with, and their places in the order."""
    order = sets.sparkSession.sparkContext.broadcast(frequencies(sets, counters))  # so many numbers

    def run(batches):
        for batch in batches:
            rare, took = [], []
            for x in batch.column("hashes"):
                own = np.frombuffer(x.as_buffer(), np.uint64)
                took.append(len(own) + 1 + (-num * len(own) // den))
                rare.append(own[np.lexsort((own, order.value[_slot(own, counters)]))[: took[-1]]])
            if took:
                which = pa.array(np.repeat(np.arange(len(took)), took))
                n = np.repeat([len(x.as_buffer()) // 8 for x in batch.column("hashes")], took)
                yield table(RARE, np.concatenate(rare).view(np.int64), *(batch.column(c).take(which) for c in ("ck", "comp")), n, np.concatenate([np.arange(k) for k in took]).astype(np.int32))

    return sets.select("ck", "comp", "hashes").mapInArrow(run, "h long, ck binary, comp binary, n long, at int")


def apart(store: Store, rare: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b), a < b: pairs of different components with a rare shingle in common and room for a link by their sizes and what is left of both sets."""
    rare = store.put(rare, "rare")
    by = rare.groupBy("h").agg(F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("h", "size")
    split = store.put(attach(store, rare, by.withColumn("rows", F.col("size")), "h", "size", rare.count()), "split")
    main = split.groupBy("h", "comp").agg(F.count("*").alias("share"), F.max("rows").alias("rows")).groupBy("h").agg(F.max_by("comp", F.struct("share", "comp")).alias("main"), F.max("rows").alias("size"))
    placed = attach(store, split, main, "h", "size", split.count()).withColumn("salts", F.ceil(F.col("rows") / MEET_ROWS).cast("int"))
    few = placed.filter("comp <> main").select("h", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("ck").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("at").alias("ia"))
    every = placed.select("h", F.pmod(F.xxhash64("ck"), "salts").cast("int").alias("salt"), F.col("ck").alias("b"), F.col("comp").alias("cb"), "main", F.col("n").alias("nb"), F.col("at").alias("ib"))
    sizes = F.least("na", "nb") * den >= F.greatest("na", "nb") * num
    left = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) * (num + den) >= (F.col("na") + F.col("nb")) * num  # at the first shingle in common
    # of two linked sets the smaller shares one of its first shingles; without them texts of one template would all meet
    first = lambda n, at: F.expr(f"{at} <= {n} - ceil({2 * num} * {n} / {num + den})")
    small, large = few.filter(first("na", "ia")).join(every, ["h", "salt"]).filter("na <= nb"), few.join(every.filter(first("nb", "ib")), ["h", "salt"]).filter("na > nb")
    got = small.unionByName(large).filter(F.expr("ca <> cb and (cb = main or a < b)") & sizes & left)
    return got.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verify(store: Store, pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets have ``den * |intersection| >= num * |union|``.

    The leaders' sets are sent once for every ``SALT_ROWS`` of their members, and a task streams
    over the members with one leader's set in memory: no group is ever held, whatever its size.
    """
    size = store.put(pairs.groupBy("a").agg(F.count("*").alias("size")).withColumn("salts", F.ceil(F.col("size") / SALT_ROWS).cast("int")), "sizes")
    salted = store.put(attach(store, pairs, size, "a", "size", pairs.count()).select("a", "b", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt")), "salted")
    member = sets.withColumnRenamed("ck", "b").join(shuffled(salted), "b").select("a", "b", "salt", "n", "hashes")
    leader = sets.withColumnRenamed("ck", "a").join(shuffled(size), "a").select("a", F.lit(None).cast("binary").alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "n", "hashes")

    def run(batches):
        whose, own = None, None
        for batch in batches:
            a, b, got = [], [], batch.column("hashes")
            for x, y, s in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), got):
                s = np.frombuffer(s.as_buffer(), np.uint64)
                if y is None:
                    whose, own = x, s
                    continue
                assert x == whose
                small, large = (s, own) if len(s) < len(own) else (own, s)
                if den * len(small) < num * len(large):
                    continue
                at = np.searchsorted(large, small)
                both = int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small))
                if den * both >= num * (len(s) + len(own) - both):
                    a.append(x)
                    b.append(y)
            yield table(EDGES, a, b)
        release()

    return leader.union(member).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(run, "a binary, b binary")


def decisions(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, k: int = 5, num: int = 80, den: int = 100,
    bands: int = 24, rows: int = 4, universe_bits: int = 20, seed: int = 17,
) -> DataFrame:
    """(id, row, n, component_id, first) of each row of ``docs``; ``first`` holds of one row of each component, that of the smallest id (null last) and row key.

    ``row_col`` names a column of row keys that stay the same from job to job; without it they are made.
    """
    spark = docs.sparkSession
    store = Store(spark)
    if row_col is None:
        docs, row_col = with_row_key(two_columns(docs, id_col, text_col), store)
        id_col, text_col = "id", "text"
    docs = two_columns(docs, id_col, text_col, F.col(row_col).alias("row"))
    sigs = store.put(signatures(docs, k, bands, rows, universe_bits, seed), "sigs")
    top = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("top")
    classes = store.put(sigs.filter("n > 0").groupBy("ck").agg(top, F.count("*").alias("copies"), F.min_by("bands", "row").alias("bands")), "classes")
    keyed = classes.select("ck", F.explode("bands").alias("bk"))
    sizes = keyed.groupBy("bk").agg(F.count("*").alias("size")).filter("size > 1")
    shared = store.put(attach(store, keyed, sizes.withColumn("members", F.col("size")), "bk", "size", classes.count() * bands), "shared")
    # copies of one original meet it in more buckets, and larger ones, than each other
    score = shared.groupBy("ck").agg(F.sum("members").alias("score"))
    members = store.put(shared.select("bk", "ck").join(score, "ck"), "members")
    n_members = members.count()
    hubs = members.groupBy("bk").agg(F.max_by("ck", F.struct("score", "ck")).alias("hub"), F.count("*").alias("size"))
    wanted = store.put(members.select("ck").distinct().join(classes.select("ck", F.col("top.row").alias("row")), "ck"), "wanted")
    sets = store.put(shingle_sets(docs.join(shuffled(wanted), "row"), k), "sets")

    pairs = store.put(attach(store, members.select("bk", "ck"), hubs, "bk", "size", n_members).select(F.col("hub").alias("a"), F.col("ck").alias("b")).filter("a <> b").distinct(), "pairs")
    links = store.put(verify(store, pairs, sets, num, den), "verified")
    comps = components(store, links)

    placed = store.put(members.select("bk", "ck").join(comps.withColumnRenamed("node", "ck"), "ck", "left").withColumn("comp", F.coalesce("comp", "ck")), "placed")
    broken = placed.groupBy("bk").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size")).filter("low <> high").select("bk", "size")
    rest = store.put(attach(store, placed, broken, "bk", "size", n_members).select("ck", "comp").distinct(), "broken")
    if not rest.isEmpty():
        more = apart(store, rarest(sets.join(shuffled(rest), "ck"), num, den), num, den)
        more = store.put(more.join(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "more")
        links = store.put(verify(store, more, sets, num, den), "verified2")
        if not links.isEmpty():
            comps = components(store, links.union(comps.select(F.col("node").alias("a"), F.col("comp").alias("b"))))

    # classes of a component, then the rows of a class: either may be a third of all
    whole = classes.select("ck", "top", "copies").join(comps.withColumnRenamed("node", "ck"), "ck", "left").withColumn("comp", F.coalesce("comp", "ck"))
    least = whole.groupBy("comp").agg(F.min("top").alias("least"), F.count("*").alias("size"))
    placed = store.put(attach(store, whole.select("ck", "copies", "comp"), least, "comp", "size", classes.count()).select("ck", "copies", "least"), "classes2")
    light = sigs.select("id", "row", "n", "ck")
    some = attach(store, light.filter("ck is not null"), placed, "ck", "copies", sigs.count())
    first = F.col("id").eqNullSafe(F.col("least.id")) & (F.col("row") == F.col("least.row"))
    none = light.filter("ck is null").select("id", "row", "n", F.col("id").alias("component_id"), F.lit(True).alias("first"))
    return some.select("id", "row", "n", F.when(F.col("id").isNotNull(), F.col("least.id")).alias("component_id"), first.alias("first")).union(none)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, **settings) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id it reaches by links) and kept.

    Null and blank texts have an empty set and link with nothing; a text of fewer than ``k``
    words is one shingle.  Rows with one id stand for themselves, so an id may repeat; a null id
    is its own component with null as its id and is kept.  Other columns are not read.
    """
    got = decisions(docs, id_col=id_col, text_col=text_col, k=k, **settings)
    return got.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id").withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def first_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, **settings) -> DataFrame:
    """The rows of ``docs``, all columns, less those that are not the one kept row of their component.

    Of exact and near copies, and of equal rows, the row of the smallest id stays (a null id comes
    last; among rows of one id any one, the same in every run over the same files).  A row is
    judged by its own text: others of its id may go or stay.  Rows with an empty set stay.
    """
    keyed, key = with_row_key(docs, Store(docs.sparkSession))
    gone = decisions(keyed, id_col=id_col, text_col=text_col, row_col=key, k=k, **settings).filter("not first")
    gone = gone.select(F.col("row").alias(key), F.col("id").alias(f"{key}_id"))
    same = (keyed[key] == gone[key]) & keyed[f"`{id_col}`"].cast("long").eqNullSafe(gone[f"{key}_id"])
    return keyed.join(shuffled(gone), same, "left_anti").select(docs.columns)


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components and kept documents of the whole ``documents`` table under 4-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4)
