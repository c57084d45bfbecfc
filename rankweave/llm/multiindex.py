"""Near-duplicate vectors by an inverted multi-index with exact verification.

Two codebooks, one for each half of the unit vectors, form a grid of cells (Babenko and
Lempitsky, 2012); the grid's size follows the number of rows, so that a cell keeps about
``CELL_ROWS`` of them.  A vector visits cells in order of ``m1**2 + m2**2``, where m is the
distance from its half to the border of the cell's Voronoi region.  That sum is a lower bound
of the squared distance to anything in the cell, so once it exceeds ``radius**2 = 2 - 2 *
threshold`` no cell further on can hold a link, and recall is 1; a target below 1 stops at
the share of ``radius**2`` that the index of a sample shows to be enough.

A pair is met once: of two cells the one of the smaller number asks the other.  Cells are
verified by blocks of ``BLOCK`` index rows by ``BLOCK`` queries, so a hot cell is many tasks of
bounded memory; probes carry keys, and a vector joins them for its blocks alone, in 4 bytes a
component where those hold it exactly.  A block returns link counts of its vectors and a
spanning forest of its links, never its pairs.  Equal vectors are one member with a multiplicity.
"""

from __future__ import annotations

import hashlib
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import Store, bounded_sample, near_fraction, table
from .graph import attach, components

CELL_ROWS, BLOCK = 1024, 1024
PACKED = pa.schema([("id", pa.int64()), ("ck", pa.binary()), ("g", pa.string()), ("vec", pa.binary())])
PROBES = pa.schema([("ck", pa.binary()), ("g", pa.string()), ("cell", pa.int64()), ("home", pa.bool_())])


def codebook(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means centres (Lloyd) from ``x``; fewer rows than k give fewer centres."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        near = ((c**2).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return np.unique(c, axis=0)


def distances(c: np.ndarray) -> np.ndarray:
    """Between all centres; never 0."""
    square = (c**2).sum(axis=1)
    return np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * c @ c.T, 1e-300))


def borders(x: np.ndarray, c: np.ndarray, between: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row, and its squared distance to the Voronoi border of every centre's region."""
    d = (x**2).sum(axis=1)[:, None] + (c**2).sum(axis=1)[None, :] - 2 * x @ c.T
    near = d.argmin(axis=1)
    between = distances(c) if between is None else between
    m = np.maximum(d - d[np.arange(len(x)), near][:, None], 0) / (2 * between[near])
    m[np.arange(len(x)), near] = 0
    return near, m**2


def traverse(m1: np.ndarray, m2: np.ndarray, stop: float) -> list[tuple[int, int]]:
    """Cells in order of m1 + m2 (squared border distances), none beyond ``stop``.

    The multi-sequence walk: both halves' distances are sorted, and a heap holds for each entry
    of the first sequence the next one of the second, so the work follows the cells visited.
    """
    a, b = np.flatnonzero(m1 <= stop), np.flatnonzero(m2 <= stop)
    if not len(a) or not len(b):
        return []
    a, b = a[np.argsort(m1[a], kind="stable")].tolist(), b[np.argsort(m2[b], kind="stable")].tolist()
    x, y = m1[a].tolist(), m2[b].tolist()
    heap, out = [(x[0] + y[0], 0, 0)], []
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > stop:
            break
        out.append((a[i], b[j]))
        if j + 1 < len(y):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if not j and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
    return out


class Index:
    """Codebooks of one vector length and the rule that ends a traversal."""

    def __init__(self, sample: np.ndarray, rows: int, threshold: float, recall: float, seed: int = 9):
        k = int(min(max(2, len(sample) // 4), max(2, math.ceil((rows / CELL_ROWS) ** 0.5))))
        self.half = max(1, sample.shape[1] // 2)
        self.books = codebook(sample[:, : self.half], k, seed), codebook(sample[:, self.half :] if sample.shape[1] > 1 else np.zeros((1, 1)), k, seed + 1)
        self.between = tuple(distances(c) for c in self.books)
        self.radius = 2 - 2 * threshold + 1e-9
        self.stop = self.radius
        if recall < 1:
            near = sample @ sample[:2000].T >= threshold
            q, y = np.nonzero(near & (np.arange(len(sample))[:, None] != np.arange(near.shape[1])[None, :]))
            if len(q):
                (_, _), (m1, m2) = self.cells(sample[q])
                (o1, o2), _ = self.cells(sample[y])
                self.stop = min(self.radius, float(np.quantile(m1[np.arange(len(q)), o1] + m2[np.arange(len(q)), o2], recall)))

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :] if x.shape[1] > 1 else np.zeros((len(x), 1))

    def cells(self, x: np.ndarray):
        (n1, m1), (n2, m2) = (borders(h, c, b) for h, c, b in zip(self.halves(x), self.books, self.between))
        return (n1, n2), (m1, m2)

    def probes(self, x: np.ndarray):
        """(row, cell, whether it is the row's own) of each cell that a row lies in or asks: cells of larger numbers than its own that may hold links."""
        wide = len(self.books[1])
        for first in range(0, len(x), step := max(1, (1 << 21) // max(map(len, self.books)))):
            (n1, n2), (m1, m2) = self.cells(x[first : first + step])
            for i, home in enumerate((n1.astype(np.int64) * wide + n2).tolist()):
                yield first + i, home, True
                for a, b in traverse(m1[i], m2[i], self.stop):
                    if a * wide + b > home:
                        yield first + i, a * wide + b, False


def unit(raw: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision; components have 4 bytes where those hold them exactly, else 8."""
    if all(len(r) == 4 * dim for r in raw):
        x = np.frombuffer(b"".join(raw), np.float32).reshape(-1, dim).astype(np.float64)
    else:
        x = np.stack([np.frombuffer(r, np.float32 if len(r) == 4 * dim else np.float64).astype(np.float64) for r in raw])
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x**2).sum(axis=1))[:, None]


def _forest(linked: np.ndarray, q: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """A row of the same component for each query and index row with a link."""
    big = linked.shape[1]
    low_y = np.arange(big)
    while True:
        low_q = np.where(linked, low_y[None, :], big).min(axis=1)
        new = np.minimum(low_y, np.where(linked, low_q[:, None], big).min(axis=0))
        if np.array_equal(new, low_y):
            break
        low_y = new
    some_q, some_y = np.flatnonzero(low_q < big), np.flatnonzero(linked.any(axis=0))
    return [*zip(q[some_q].tolist(), y[low_q[some_q]].tolist()), *zip(y[some_y].tolist(), y[low_y[some_y]].tolist())]


def vector_duplicates(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
    threshold: float = 0.98, recall: float = 1.0, most: int = 20_000,
) -> DataFrame:
    """One row per row of ``vectors``: id, n_links (others with cosine >= threshold), component_id (smallest id reached) and kept.

    Only rows of equal, non-null label and equal length are compared; null and zero vectors and
    those with null or non-finite components link with nothing.  Ids may repeat (rows count, and
    copies under one id link); a null id is its own component and kept if it has no other.
    Codebooks are fitted on at most ``most`` distinct vectors; every row is indexed.  Other columns are not read.
    """
    spark = ship(vectors.sparkSession)
    store = Store(spark)
    label = F.col(f"`{label_col}`").cast("string") if label_col else F.lit("")
    raw = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    fine = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.expr("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))") & F.expr("exists(v, x -> x <> 0)")

    def pack(batches):
        for b in batches:
            v = b.column("v")
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # -0.0 is 0.0
            with np.errstate(over="ignore"):
                narrow = flat.astype(np.float32)
            at = np.concatenate([[0], np.cumsum(v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            lost = np.concatenate([[0], np.cumsum(narrow != flat)])
            good = lost[at[1:]] == lost[at[:-1]]
            ck, g, vec = [None] * b.num_rows, [None] * b.num_rows, [None] * b.num_rows
            for i, (s, ok) in enumerate(zip(b.column("label").to_pylist(), b.column("fine").to_pylist())):
                if ok:
                    g[i] = f"{at[i + 1] - at[i]}:{s}"
                    vec[i] = (narrow if good[i] else flat)[at[i] : at[i + 1]].tobytes()
                    ck[i] = hashlib.blake2b(g[i].encode() + b"\0" + vec[i], digest_size=16).digest()
            yield table(PACKED, b.column("id"), ck, g, vec)

    rows = store.put(raw.withColumn("fine", F.coalesce(fine, F.lit(False))).mapInArrow(pack, "id long, ck binary, g string, vec binary"), "rows")
    classes = store.put(rows.filter("ck is not null").groupBy("ck").agg(F.min("g").alias("g"), F.min("vec").alias("vec"), F.min("id").alias("top"), F.count("*").alias("copies")), "classes")
    sizes = classes.groupBy("g").agg(F.count("*").alias("n")).groupBy(F.substring_index("g", ":", 1).cast("int").alias("dim")).agg(F.max("n").alias("n")).collect()  # one row a vector length
    links = None
    for dim, n in sizes:
        part = classes.filter(F.col("g").startswith(f"{dim}:"))
        sample = sorted(bytes(r[0]) for r in bounded_sample(near_fraction(part.select("ck", "vec"), "ck", most), most, "vec").select("vec").collect())
        index = spark.sparkContext.broadcast(Index(unit(sample, dim), n, threshold, recall))  # at most ``most`` / 4 centres a half

        def probe(batches, index=index, dim=dim):
            for batch in batches:
                if batch.num_rows:
                    ck, g = batch.column("ck").to_pylist(), batch.column("g").to_pylist()
                    out = [(ck[i], g[i], cell, home) for i, cell, home in index.value.probes(unit(batch.column("vec").to_pylist(), dim))]
                    yield table(PROBES, *map(list, zip(*out)))

        probes = store.put(part.select("ck", "g", "vec").mapInArrow(probe, "ck binary, g string, cell long, home boolean"), "probes")
        cells = probes.groupBy("g", "cell").agg(F.count(F.when(F.col("home"), 1)).alias("homes"), F.count("*").alias("size")).filter("homes > 0 and size > 1")
        cells = cells.select("g", "cell", "size", F.ceil(F.col("homes") / BLOCK).cast("int").alias("nb"), F.ceil(F.col("size") / BLOCK).cast("int").alias("ns"), F.struct("g", "cell").alias("at"))
        h = lambda n: F.pmod(F.xxhash64("ck"), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        busy = attach(store, probes.withColumn("at", F.struct("g", "cell")).drop("g", "cell"), cells, "at", "size", probes.count()).withColumns({"hb": h("nb"), "hs": h("ns")})
        asked = busy.filter("home").withColumn("b", F.col("hb")).withColumn("s", every("ns")).withColumns({"own": F.lit(True), "asks": F.col("s") == F.col("hs")})
        asking = busy.withColumn("s", F.col("hs")).withColumn("b", every("nb")).filter("not (home and b = hb)").withColumns({"own": F.lit(False), "asks": F.lit(True)})
        blocks = asked.unionByName(asking).select("at", "b", "s", "ck", "home", "own", "asks").join(part.select("ck", "copies", "vec"), "ck")

        def verify(key, own):
            dim = int(key[0].as_py()["g"].split(":")[0])
            mine, asks, home = (own.column(c).to_numpy() for c in ("own", "asks", "home"))
            ck, copies = own.column("ck").to_numpy(), own.column("copies").to_numpy()
            a, b, n = [], [], []
            if mine.any() and asks.any():
                x = unit(own.column("vec").to_pylist(), dim)
                q, y = np.flatnonzero(asks), np.flatnonzero(mine)
                linked = (x[q] @ x[y].T >= threshold) & (q[:, None] != y[None, :])
                there = linked[~home[q]].T @ copies[q[~home[q]]]  # pairs within a cell are met from both sides
                for i, count in ((q, linked @ copies[y]), (y, there)):
                    some = count > 0
                    a += ck[i[some]].tolist()
                    b += [None] * int(some.sum())
                    n += count[some].tolist()
                for u, v in _forest(linked, q, y):
                    if u != v:
                        a.append(ck[u])
                        b.append(ck[v])
                        n.append(0)
            return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "n": pa.array(n, pa.int64())})

        found = blocks.groupBy("at", "b", "s").applyInArrow(verify, "a binary, b binary, n long")
        links = found if links is None else links.union(found)
    alone = rows.filter("ck is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if links is not None:
        links = store.put(links, "links")
        counts = links.filter("b is null").groupBy(F.col("a").alias("ck")).agg(F.sum("n").alias("n"))
        comps = components(store, links.filter("b is not null").select("a", "b")).withColumnRenamed("node", "ck")
        # classes of a component, then the rows of a class: either may be a third of all
        whole = classes.select("ck", "top", "copies").join(counts, "ck", "left").join(comps, "ck", "left").withColumn("comp", F.coalesce("comp", "ck"))
        least = whole.groupBy("comp").agg(F.min("top").alias("component_id"), F.count("*").alias("size"))
        n_links = (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
        placed = store.put(attach(store, whole, least, "comp", "size", classes.count()).select("ck", "copies", n_links, "component_id"), "placed")
        alone = attach(store, rows.filter("ck is not null").select("id", "ck"), placed, "ck", "copies", rows.count()).select("id", "n_links", "component_id").union(alone)
    return alone.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())).withColumnRenamed("id", id_col)


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of the whole ``embeddings`` table at cosine 0.98 within labels."""
    return vector_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
