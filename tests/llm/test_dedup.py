"""Near duplicates of texts and of vectors, against brute force."""

import collections
import random
import re

import numpy as np
import pytest

from rankweave.llm import graph, minhash, multiindex
from rankweave.llm import words as W
from rankweave.llm.common import Store
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        up[top(a)] = top(b)
    return [top(x) for x in range(n)]


def brute(rows, k):
    """(id, n, component id, kept) of each row, in order, by all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = components(len(rows), links)
    low = {}
    for (i, _), c in zip(rows, comp):
        if i is not None:
            low[c] = min(low.get(c, i), i)
    out = []
    for (i, _), s, c in zip(rows, sets, comp):
        out.append((i, len(s), None if i is None else low[c], i is None or low[c] == i))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


@pytest.mark.parametrize("k", [4, 5])
def test_odd_texts(spark, odd, k):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(minhash.near_duplicates(odd, k=k)) == brute(rows, k)


def test_table_with_hot_keys(spark, monkeypatch):
    """The same with every key hot."""
    monkeypatch.setattr(graph, "HOT_ROWS", 0)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(minhash.op3_minhash_dedup(spark, SF)) == brute([(r.doc_id, r.text) for r in docs.collect()], 4)


def test_no_rows(spark, none):
    assert minhash.near_duplicates(none).count() == 0


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(minhash.op3_minhash_dedup(spark, SF)) == brute([(r.doc_id, r.text) for r in docs.collect()], 4)


def test_groups_of_edited_copies(spark):
    """Chains and stars: copies of one original that link to it, or only to each other."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(120):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(60)] = f"x{rng.randrange(10_000)}"
        texts.append(" ".join(own))
    texts += [" ".join(base[i:] + [f"y{j}" for j in range(i)]) for i in range(0, 40)]
    rows = list(enumerate(texts))
    assert got(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4)) == brute(rows, 4)


def test_passages_that_many_documents_share(spark):
    """Half of each text is one passage, so buckets hold many documents that aren't near copies, and some that are."""
    rng = random.Random(14)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for k in range(160):
        own = [f"q{k // 2 if k % 5 == 0 else k}x{i}" for i in range(rng.choice([12, 20, 60]))]
        texts.append(" ".join([*passage, *own] if k % 3 else [*own, *passage]))
        if k % 4 == 0:
            texts.append(texts[-1] + f" tail{k}")
    rows = list(enumerate(texts))
    want = brute(rows, 4)
    assert 20 < len({x[2] for x in want}) < len(rows)
    assert got(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4)) == want


def test_pages_of_one_template(spark):
    """Common words and few of their own: not near copies, and candidates do not grow with the square of the pages."""
    page = lambda i: f"home news about c{i} us login a b c d{i} e f g"
    rows = [(i, page(i)) for i in range(600)] + [(600 + i, page(i).upper()) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = minhash.near_duplicates(docs, k=4).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: i if i < 600 else i - 600 for i in range(605)}
    words = np.arange(13)[None, :] + np.where(np.isin(np.arange(13), (3, 9)), 1000 * (1 + np.arange(600))[:, None], 0)
    sets = [np.unique([hash(tuple(w[i : i + 3])) & 0xFFFFFFFFFFFF for i in range(11)]).astype(np.uint64) for w in words.tolist()]
    df = spark.createDataFrame([(bytearray(i.to_bytes(2)), bytearray(i.to_bytes(2)), len(x), bytearray(x.tobytes())) for i, x in enumerate(sets)], "ck binary, comp binary, n long, hashes binary")
    assert minhash.apart(Store(spark), minhash.rarest(df, 80, 100), 80, 100).count() == 0


def test_rare_shingles_hold_every_link(spark, monkeypatch):
    """Pairs by prefix filter are all linked pairs of different components, whatever the order's counters hold, split groups too."""
    monkeypatch.setattr(minhash, "MEET_ROWS", 3)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, 80, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(60, 81)], rng.integers(0, 1 << 64, rng.integers(1, 12), dtype=np.uint64)])) for _ in range(60)]
    name = lambda i: bytes([i])
    df = spark.createDataFrame([(bytearray(name(i)), bytearray(name(200 + i % 7 if i < 20 else i)), len(x), bytearray(x.tobytes())) for i, x in enumerate(sets)], "ck binary, comp binary, n long, hashes binary")
    pairs = {(bytes(r.a)[0], bytes(r.b)[0]) for r in minhash.apart(Store(spark), minhash.rarest(df, 80, 100, 1 << 8), 80, 100).collect()}
    comp = lambda i: i % 7 if i < 20 else 100 + i
    linked = {(a, b) for b in range(60) for a in range(b) if comp(a) != comp(b) and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert linked and linked <= pairs


@pytest.mark.parametrize("hot_rows", [1000, 10_000])
def test_joins_on_hot_keys(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(graph, "HOT_ROWS", hot_rows)
    big = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(5000)], "k long, x long")
    small = big.groupBy("k").agg({"*": "count"}).withColumnRenamed("count(1)", "n").selectExpr("k", "n", "k * 2 as y").filter("k <> 9")
    out = graph.attach(Store(spark), big, small, "k", "n", 5000)
    assert sorted((r.k, r.x, r.y) for r in out.collect()) == sorted((k, i, 2 * k) for i in range(5000) if (k := 0 if i % 3 else i) != 9)


def test_one_row_of_each_component_stays(spark, odd, none, tmp_path):
    """Rows are judged by their own text: repeated rows leave one, another text under a duplicate's id stays, and so do rows without words."""
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(3, near), (7, near + " end"), (7, "a text unlike anything else here"), (5, near), (5, near), (None, near), (None, "only here and nowhere else"), (9, None), (9, None), (9, " "), (8, "short"), (8, "short")]
    rows = [(i, t, k, "x", 0) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark int, row_key string, _metadata int")
    df.coalesce(1).write.parquet(f"file://{tmp_path}/rows")
    for docs in (df, spark.read.parquet(f"file://{tmp_path}/rows"), df.repartition(5)):
        out = minhash.first_of_each(docs)
        kept = [r.mark for r in out.collect()]
        assert out.columns == df.columns and len(kept) == 7 and set(kept) - {10, 11} == {0, 2, 6, 7, 8, 9}
    for docs in (odd, none):
        sets = [shingles(r.text, 5) for r in docs.collect()]
        links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        assert minhash.first_of_each(docs).count() == len(set(components(len(sets), links)))


def test_word_hashes():
    texts = ["A b\tc", "", " a  B C ", "é É", "x" * 300]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    start, end, word_at = W.spans(data, at)
    words = [data[a:b].tobytes().decode() for a, b in zip(start, end)]
    assert words == [w for t in texts for w in WORD.findall(t)] and word_at.tolist() == [0, 3, 3, 6, 8, 9]
    h = W.hashes(data, start, end)
    assert (h[:3] == h[3:6]).all() and len(set(h.tolist())) == 6


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 64, 1200, dtype=np.uint64)
    x, y = (minhash.signature(np.unique(s), 20, 512, 5) for s in (a[:1000], a[200:]))
    assert abs((x == y).mean() - 800 / 1200) < 0.08
    z = minhash.signature(np.unique(a), 20, 8, 5)
    scatter, _ = minhash.permutations(20, 8, 5)
    slots = scatter[(np.unique(a) >> np.uint64(44)).astype(int)].astype(np.int64)
    ranks = np.array([minhash.permutations(20, 1, 5)[1][s, 0] for s in range(1 << 20)])
    assert [ranks[(slots + k) % (1 << 20)].min() for k in range(8)] == z.tolist()


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    comp = components(400, links)
    low = {}
    for x in range(400):
        low[comp[x]] = min(low.get(comp[x], x), x)
    got = {r.node: r.comp for r in graph.components(Store(spark), spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: low[comp[x]] for e in links if e[0] != e[1] for x in e}
    assert graph.components(Store(spark), spark.createDataFrame([], "a long, b long")).count() == 0


def vector_brute(rows, threshold=0.98):
    """(id, links, component, kept) of rows (id, label, vector)."""
    n = len(rows)
    unit = []
    for _, label, v in rows:
        x = np.array([np.nan if y is None else y for y in v], float) if v is not None else None
        ok = label is not None and x is not None and len(x) and np.isfinite(x).all() and x.any()
        unit.append(x / np.sqrt((x * x).sum()) if ok else None)
    links = [(a, b) for a in range(n) for b in range(a) if unit[a] is not None and unit[b] is not None and rows[a][1] == rows[b][1] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    degree = collections.Counter(x for e in links for x in e)
    comp, low = components(n, links), {}
    for k, c in enumerate(comp):
        if rows[k][0] is not None:
            low[c] = min(low.get(c, rows[k][0]), rows[k][0])
    return sorted(((rows[k][0], degree[k], low.get(c), low.get(c) in (None, rows[k][0])) for k, c in enumerate(comp)), key=str)


def links_of(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


SCHEMA = "vec_id long, label int, embedding array<double>, row string, g string"


def test_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(0, 1, None), (1, 1, []), (2, 1, [0.0, 0.0]), (3, 1, [1.0, None]), (4, 1, [float("nan"), 1.0]), (5, 1, [float("inf"), 1.0]), (6, None, [1.0, 2.0]), (7, 1, [1.0, 2.0]), (8, 1, [2.0, 4.0]), (8, 1, [2.0, 4.0]), (9, 2, [1.0, 2.0]), (10, 1, [5.0]), (11, 1, [7.0])]
    centre = rng.normal(size=16)
    for k in range(150):  # a crowded spot and scattered vectors
        rows.append((100 + k, k % 3, (centre + rng.normal(size=16) * 0.12 * (k % 5)).tolist() if k < 90 else rng.normal(size=16).tolist()))
    df = spark.createDataFrame([(*r, "r", "g") for r in rows], SCHEMA)
    assert links_of(multiindex.vector_duplicates(df)) == vector_brute(rows)
    assert multiindex.vector_duplicates(df.limit(0)).count() == 0
    assert links_of(multiindex.vector_duplicates(df.filter("vec_id in (0, 6)"))) == [(0, 0, 0, True), (6, 0, 6, True)]


def test_vector_table_and_recall(spark):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert links_of(multiindex.op8_vector_dedup(spark, SF)) == vector_brute(rows)
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    full, part = (multiindex.vector_duplicates(vectors, threshold=0.5, recall=r).agg({"n_links": "sum"}).first()[0] for r in (1.0, 0.95))
    assert full == sum(x[1] for x in vector_brute(rows, 0.5)) and 0.9 * full <= part <= full


def test_blocks_of_one_cell_and_wide_numbers(spark, monkeypatch):
    """Cells of several blocks on both sides, and components that 4 bytes don't hold."""
    monkeypatch.setattr(multiindex, "BLOCK", 7)
    monkeypatch.setattr(multiindex, "CELL_ROWS", 16)
    rng = np.random.default_rng(8)
    centre = rng.normal(size=6)
    rows = []
    for k in range(160):
        v = centre + rng.normal(size=6) * (0.01 if k % 2 else 0.5)
        rows.append((k, 1, (v.astype(np.float32).astype(float) if k % 3 else v * (1e200 if k % 7 == 0 else 1)).tolist()))
    rows += [(200 + k, 1, rows[5][2]) for k in range(30)]
    df = spark.createDataFrame([(*r, "r", "g") for r in rows], SCHEMA)
    assert links_of(multiindex.vector_duplicates(df)) == vector_brute([(i, g, (np.array(v) / np.abs(v).max()).tolist()) for i, g, v in rows])


def test_border_distance_is_a_lower_bound():
    rng = np.random.default_rng(6)
    c, x, y = rng.normal(size=(9, 5)), rng.normal(size=(40, 5)), rng.normal(size=(60, 5))
    _, m = multiindex.borders(x, c)
    near, _ = multiindex.borders(y, c)
    d = ((x[:, None] - y[None]) ** 2).sum(axis=2)
    assert (m[:, near] <= d + 1e-9).all()
    cells = multiindex.traverse(np.array([0.0, 3, 1]), np.array([2.0, 0]), 3.0)
    assert cells[:3] == [(0, 1), (2, 1), (0, 0)] and set(cells[3:]) == {(1, 1), (2, 0)}
    for _ in range(50):
        m1, m2, stop = rng.random(9), rng.random(7), rng.random() * 1.5
        cells = multiindex.traverse(m1, m2, stop)
        assert sorted(cells) == [(i, j) for i in range(9) for j in range(7) if m1[i] + m2[j] <= stop]
        assert (np.diff([m1[i] + m2[j] for i, j in cells]) >= 0).all()
