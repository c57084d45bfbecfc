"""Ranked lexical search: the documents of highest score for each item of a query table, exactly.

A document's score for an item is the sum of its impacts over the item's terms; a term's impact is
its weight times a part that grows with its number in the document and falls with its length.

1. One scan turns documents into rows of terms and numbers.  Terms of no item are left out by a
   bitmap of fixed size; the few that slip through meet no item.
2. Per term the largest and the kth largest impact are stored, and the number of documents.
3. The kth best score of an item is at least the largest kth impact of its terms: its threshold.  Its
   terms go by falling largest impact; where the sum of this and all later largest impacts is below
   the threshold, a document that holds none but these terms is not among the best.  The terms
   before are the item's seeds.
4. Seeds alone give candidates, a candidate goes on if its seeds' impacts and the bound of the
   others reach the threshold, and those that do are scored on all terms.  Each task raises its
   thresholds to the kth best score that it has seen, and hands on k documents an item.

The items meet the documents in blocks of about ``BLOCK`` terms (an item is in one block), each sent
to all tasks; a block reads the rows of step 1, not the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Store, pieces, release, table, two_columns, with_row_key
from .words import hashes, spans

K, BLOCK, SALTS = 50, 1 << 19, 256
#: Terms, and meetings of a term with an item, of the documents that a task takes at once (one document may be over it).
AT_ONCE = 1 << 18
#: Slots of the bitmap of the items' terms.
SLOTS = 1 << 24
_BREAK = np.ones(256, bool)  # all of ASCII but letters and digits
_BREAK[48:58] = _BREAK[65:91] = _BREAK[97:123] = _BREAK[128:] = False
TERMS = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32()))])
TERMS_SQL = "row long, id long, n long, terms array<long>, counts array<int>"
PEAKS = pa.schema([("term", pa.int64()), ("df", pa.int64()), ("peaks", pa.list_(pa.int64()))])
BEST = pa.schema([("item", pa.int64()), ("id", pa.int64()), ("score", pa.int64()), ("salt", pa.int32())])


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def term_rows(docs: DataFrame, bitmap: np.ndarray | None = None) -> DataFrame:
    """(row, id, n, terms, counts) of (row, id, text): number of terms with repeats, and the distinct ones by hash with their numbers, those of the bitmap only if one is given.

    Rows without terms are left out.
    """
    held = docs.sparkSession.sparkContext.broadcast(bitmap) if bitmap is not None else None  # of fixed size

    def run(batches):
        for batch, data, at in pieces(batches):
            start, end, word_at = spans(data, at, _BREAK)
            term = hashes(data, start, end)
            n = np.diff(word_at)
            which = np.repeat(np.arange(len(n)), n)
            if held is not None:
                slot = (term >> np.uint64(40)).astype(np.int64)
                some = (held.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
                term, which = term[some], which[some]
            by = np.lexsort((term, which))
            term, which = term[by], which[by]
            new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (which[1:] != which[:-1])])) if len(term) else np.zeros(0, np.int64)
            size = np.bincount(which[new], minlength=len(n))
            full = np.flatnonzero(n)
            yield table(
                TERMS, batch.column("row").take(pa.array(full)), batch.column("id").take(pa.array(full)), n[full],
                _lists(term[new].view(np.int64), size[full], pa.int64()), _lists(np.diff(np.append(new, len(term))), size[full], pa.int32()),
            )

    return docs.select("row", "id", "text").mapInArrow(run, TERMS_SQL)


def _bitmap(items: DataFrame) -> np.ndarray:
    """One bit for each slot that a term of the items falls on."""
    slot = items.select(F.explode("terms").alias("t")).select(F.shiftrightunsigned("t", 40).alias("s"))
    got = slot.groupBy(F.shiftright("s", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits")).toArrow()  # SLOTS / 64 rows at most
    out = np.zeros(SLOTS // 64, np.uint64)
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out.view(np.uint8)


def _bases(batch, n_docs: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each term of each document of a batch: the document's place, the term, and its impact without the weight."""
    terms, counts = batch.column("terms"), batch.column("counts").flatten().to_numpy().astype(np.int64)
    which = np.repeat(np.arange(batch.num_rows), terms.value_lengths().to_numpy())
    m = 50 + (50 * batch.column("n").to_numpy() * n_docs) // n_terms
    return which, terms.flatten().to_numpy(), (1_000_000_000 * counts) // (1000 * counts + 20 * m[which])


def _firsts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of a sorted array start, and the place of each element in its run."""
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return new, np.arange(len(key)) - np.repeat(new, np.diff(np.append(new, len(key))))


def _slices(batch: pa.RecordBatch, weigh, most: int):
    """Slices of a batch of documents in which ``weigh`` of the terms adds up to ``most`` or less, or that are one document."""
    sizes = batch.column("terms").value_lengths().to_numpy()
    load = np.concatenate([[0], np.cumsum(weigh(batch.column("terms").flatten().to_numpy()))])[np.concatenate([[0], np.cumsum(sizes)])]
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(load, load[start] + most, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def peaks(rows: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(term, df, peaks): in how many documents each term is, and its ``k`` largest impacts without the weight, falling."""

    def run(batches):
        for batch in batches:
            _, term, base = _bases(batch, n_docs, n_terms)
            by = np.lexsort((-base, term))
            term, base = term[by], base[by]
            new, place = _firsts(term)
            df = np.diff(np.append(new, len(term)))
            yield table(PEAKS, term[new], df, _lists(base[place < k], np.minimum(df, k), pa.int64()))
        release()

    top = F.slice(F.sort_array(F.flatten(F.collect_list("peaks")), False), 1, k).alias("peaks")
    some = rows.mapInArrow(run, "term long, df long, peaks array<long>").withColumn("salt", F.spark_partition_id() % SALTS)
    return some.groupBy("term", "salt").agg(F.sum("df").alias("df"), top).groupBy("term").agg(F.sum("df").alias("df"), top)


def bounds(items: DataFrame, terms: DataFrame, n_docs: int, k: int) -> DataFrame:
    """(item, term, w, most, rest, least): each item's terms that a document has, with weight, largest impact, the sum of this and the later largest impacts, and the item's threshold."""
    w = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    own = items.select(F.col("row").alias("item"), F.explode("terms").alias("term")).join(terms, "term").withColumn("w", w)
    own = own.select("item", "term", "w", (F.col("w") * F.col("peaks")[0]).alias("most"), F.when(F.size("peaks") >= k, F.col("w") * F.element_at("peaks", -1)).otherwise(F.lit(0)).alias("kth"))
    by_item = Window.partitionBy("item")
    return own.select("item", "term", "w", "most", F.sum("most").over(by_item.orderBy(F.desc("most"), "term").rowsBetween(0, Window.unboundedFollowing)).alias("rest"), F.max("kth").over(by_item).alias("least"))


class _Block:
    """The terms of a block of items, by term, and each item's threshold."""

    def __init__(self, got: pa.Table):
        self.items, item = np.unique(got.column("item").to_numpy(), return_inverse=True)
        term = got.column("term").to_numpy()
        by = np.argsort(term, kind="stable")
        self.item, self.w, self.most, self.rest = item[by], *(got.column(c).to_numpy()[by] for c in ("w", "most", "rest"))
        self.terms, self.start = np.unique(term[by], return_index=True)
        self.end = np.append(self.start[1:], len(term))
        self.least = np.zeros(len(self.items), np.int64)
        self.least[item] = got.column("least").to_numpy()

    def met(self, term) -> np.ndarray:
        """One and the number of items that have it, of each term."""
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        return np.where(self.terms[at] == term, self.end[at] - self.start[at], 0) + 1

    def pairs(self, which, term, base, wanted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the document, place of the entry and impact, for every term of a document that is one of ``wanted`` entries."""
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        met = self.terms[at] == term
        which, at, base = which[met], at[met], base[met]
        n = self.end[at] - self.start[at]
        _, place = _firsts(np.repeat(np.arange(len(n)), n))
        entry = np.repeat(self.start[at], n) + place
        keep = wanted[entry]
        entry = entry[keep]
        return np.repeat(which, n)[keep], entry, self.w[entry] * np.repeat(base, n)[keep]


def best(rows: DataFrame, block: pa.Table, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, id, score, salt): the best of each task's documents for each item of the block, ``k`` an item at most."""
    sent = rows.sparkSession.sparkContext.broadcast(_Block(block))  # about BLOCK entries

    def run(batches):
        own = sent.value
        least, size = own.least.copy(), len(own.items)
        top = [np.zeros(0, np.int64) for _ in range(4)]  # item, score, id, whether that is none
        for batch in (own_rows for many in batches for own_rows in _slices(many, own.met, AT_ONCE)):
            which, term, base = _bases(batch, n_docs, n_terms)
            seed = own.rest >= least[own.item]
            other = np.zeros(size, np.int64)  # what an item's other terms may add
            np.maximum.at(other, own.item[~seed], own.rest[~seed])
            doc, entry, impact = own.pairs(which, term, base, seed)
            key = doc * size + own.item[entry]
            by = np.argsort(key, kind="stable")
            key = key[by]
            new, _ = _firsts(key)
            if not len(new):
                continue
            score, key = np.add.reduceat(impact[by], new), key[new]
            go = score + other[key % size] >= least[key % size]
            score, key = score[go], key[go]
            if not len(key):
                continue
            live = np.zeros(batch.num_rows, bool)
            live[key // size] = True
            live = live[which]
            doc, entry, impact = own.pairs(which[live], term[live], base[live], ~seed)
            more = doc * size + own.item[entry]
            at = np.minimum(np.searchsorted(key, more), len(key) - 1)
            met = key[at] == more
            np.add.at(score, at[met], impact[met])
            item = key % size
            go = (score >= least[item]) & (score > 0)
            ids = batch.column("id")
            none = np.array(ids.is_null())[key[go] // size].astype(np.int64)
            found = item[go], score[go], ids.fill_null(0).to_numpy()[key[go] // size], none
            item, score, ids, none = (np.concatenate(c) for c in zip(top, found))
            by = np.lexsort((ids, none, -score, item))
            _, place = _firsts(item[by])
            top = [c[by][place < k] for c in (item, score, ids, none)]
            kth = by[place == k - 1]
            least[item[kth]] = np.maximum(least[item[kth]], score[kth])
        item, score, ids, none = top
        salt = np.full(len(item), int(item.sum() + score.sum()) % SALTS)
        yield table(BEST, own.items[item], pa.array(ids, mask=none.astype(bool)), score, salt)
        release()

    return rows.mapInArrow(run, "item long, id long, score long, salt int")


def search(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", k: int = K, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item with a score above 0, equal scores by id (null last).

    Rows are judged one by one: repeated ids, of documents or items, are rows of their own.  Null
    and empty texts have no terms; an item whose terms no document has gives no row.
    """
    store = Store(docs.sparkSession)
    docs, key = with_row_key(two_columns(docs, id_col, text_col), store)
    items, item_key = with_row_key(two_columns(items, item_col, text_col), store)
    wanted = store.put(term_rows(items.withColumnRenamed(item_key, "row")), "items")
    rows = store.put(term_rows(docs.withColumnRenamed(key, "row"), _bitmap(wanted)), "terms")
    n_docs, n_terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    entries = store.put(bounds(wanted, peaks(rows, n_docs, n_terms, k), n_docs, k), "bounds")
    blocks = 1 + entries.count() // block
    got = None
    for b in range(blocks):
        mine = entries.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).toArrow()  # about ``block`` rows
        if mine.num_rows:
            part = best(rows, mine, n_docs, n_terms, k)
            got = part if got is None else got.union(store.put(part, "best"))
    if got is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("id")]
    for keys in (("item", "salt"), ("item",)):
        got = got.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    names = wanted.select(F.col("row").alias("item"), F.col("id").alias("item_id"))
    return got.join(names, "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of all ``documents`` for each ``benchmark`` item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
