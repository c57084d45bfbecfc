"""Suffix arrays, repeated passages, collocations and ranked search against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.llm import lexical, phrases, repeats
from rankweave.llm.suffix import common_prefixes, suffix_array

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _strings():
    rng = np.random.default_rng(5)
    for k in range(400):
        t = rng.integers(0, rng.integers(1, 6), rng.integers(0, 50))
        yield np.repeat(t, rng.integers(1, 6, len(t))) if k % 5 == 0 else np.tile(t[: len(t) // 5 + 1], 4) if k % 7 == 0 else t
    for text in (b"ab" * 300, b"a" * 500, b"abcabd" * 60, b"mississippi", bytes(range(256)) * 2):
        yield np.frombuffer(text, np.uint8)
    yield rng.integers(0, 100_000, 400)  # more symbols than a byte has


def test_suffix_array_and_common_prefixes():
    for t in _strings():
        order = suffix_array(t)
        text = t.tolist()
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        if len(t) and t.max() < 256:
            shared = common_prefixes(t.astype(np.uint8), order)
            for a, b in zip(order, order[1:]):
                n = next((k for k in range(len(text)) if max(a, b) + k == len(text) or text[a + k] != text[b + k]), 0)
                assert shared[b] == n
            assert not len(order) or shared[order[0]] == 0


def test_contexts_hold_every_string_once():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (0, 49, 50, 51, 400, 0, 30, 1000)] + [b"a" * 300]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    for q in repeats.GRAMS:
        first, last, anchor = repeats.contexts(data, at, q)
        got = [s for a, b in zip(first, last) for s in range(a, b + 1)]
        assert got == [s for a, b in zip(at, at[1:]) for s in range(a, b - 49)]
        of = {}
        for a, b, p in zip(first, last, anchor):
            assert all(s <= p and p + q <= s + 50 for s in range(a, b + 1))
            for s in range(a, b + 1):  # the anchor is a function of the string
                assert of.setdefault(bytes(data[s : s + 50]), p - s) == p - s


def removed(rows, size=50):
    owner = {}
    for i, t in rows:
        for s in range(len(t) - size + 1) if i is not None else ():
            owner[t[s : s + size]] = min(i, owner.get(t[s : s + size], i))
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for s in range(len(t) - size + 1) if i is not None else ():
            if owner[t[s : s + size]] < i:
                gone[s : s + size] = b"\1" * size
        kept = bytes(x for x, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def _passages():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdéöß") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(30) for _ in range(5)]
    rows = []
    for i in range(120):
        parts = [text(rng.randint(0, 25)), rng.choice(shared)[rng.randint(0, 40) :], text(rng.randint(0, 25)), rng.choice(shared), "x" * rng.randint(0, 200)]
        rows.append((rng.choice([i, i, i, 7, None]), "".join(parts)))
    return rows + [(900, "y" * 5000), (901, "y" * 60), (902, "y" * 49), (903, rows[0][1]), (904, None), (904, "")]


@pytest.mark.parametrize("meet", [repeats.MEET, 3])  # with 3 nearly all anchors are dealt anew, up to whole strings
def test_repeated_passages(spark, monkeypatch, meet):
    monkeypatch.setattr(repeats, "MEET", meet)
    rows = _passages()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "id": F.lit("z"), "base": F.lit(2)}).repartition(5)
    got = sorted((tuple(r)[:5] for r in repeats.deduplicate(docs).collect()), key=repr)
    assert got == removed([(i, (t or "").encode()) for i, t in rows])


def test_small_shards_and_odd_rows(spark, odd, none, monkeypatch):
    for name, value in (("PER_SHARD", 50), ("SHARD_BYTES", 200), ("COMBINE", 20)):
        monkeypatch.setattr(repeats, name, value)
    rows = [(r.doc_id, (r.text or "").encode()) for r in odd.collect()]
    found = repeats.deduplicate(odd).collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == removed(rows)
    for r in found:
        assert sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2])) == r.n_removed
    assert repeats.deduplicate(none).count() == 0


def best_phrases(rows, least=10, top=2000):
    counts, totals = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for n in (1, 2, 3):
                counts.update((lang, *w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for g, a in counts.items():
        if len(g) < 3 or a < least:
            continue
        cut = min((1_000_000 * a * a // (counts[g[: k + 1]] * counts[g[:1] + g[k + 1 :]]), k) for k in range(1, len(g) - 1))
        k = cut[1]
        longer = [b for h, b in counts.items() if len(h) == 4 and len(g) == 3 and b >= least and h[0] == g[0] and g[1:] in (h[1:3], h[2:4])]
        if not any(100 * b >= 50 * a for b in longer):
            out.append((g[0], " ".join(g[1:]), a, counts[g[: k + 1]], counts[g[:1] + g[k + 1 :]], totals[g[0]], cut[0]))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    rank = collections.Counter()
    return [(r[0], rank.update([r[0]]) or rank[r[0]], *r[1:]) for r in out if rank[r[0]] < top]


@pytest.mark.parametrize("shard", [phrases.SHARD, 40])
def test_collocations(spark, odd, none, monkeypatch, shard):
    monkeypatch.setattr(phrases, "SHARD", shard)
    monkeypatch.setattr(phrases, "PER_PART", 500)
    rng = random.Random(4)
    words = ["New", "york", "CITY", "a", "b", "c", "ça", "x-y\0w", "z\0", "in", "the", "of"]
    rows = []
    for _ in range(300):
        own = rng.choices(words, weights=range(12, 0, -1), k=rng.randint(0, 60))
        rows.append((rng.choice(["en", "fr", None]), "".join(w + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n"]) for w in own)))
    rows += [("en", None), ("en", ""), ("d\0e", "new york " * 20), ("en", " ".join(["a"] * 500)), (None, "...\n")]
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({"words": F.lit(1), "a": F.lit("q"), "row": F.lit(0)}).repartition(4)
    for top in (2000, 7):
        got = [tuple(r) for r in phrases.collocations(docs, top=top).orderBy("lang", "rank").collect()]
        assert got == best_phrases(rows, top=top)
    if shard == 40:
        return
    assert phrases.collocations(odd.withColumn("lang", F.col("id"))).filter("a < 10").count() == 0
    assert phrases.collocations(none.withColumn("lang", F.col("id"))).count() == 0


def ranking(rows, items, k=50):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    docs = [(i, collections.Counter(terms(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    df = collections.Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in docs:
            m = 50 + 50 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("k", "block"), [(50, lexical.BLOCK), (3, 20), (1, 4)])
def test_search(spark, odd, none, k, block):
    rng = random.Random(6)
    vocabulary = [f"t{i}" for i in range(60)] + ["Ünï", "中文", "A1"]
    text = lambda n: rng.choice([" ", "-", ", "]).join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(63)], k=n))
    rows = [(rng.choice([i, i, 5, None]), text(rng.randint(0, 80))) for i in range(400)] + [(1000, None), (1001, ""), (1002, "t3"), (1003, "t3"), (1004, "... !")]
    items = [(i, text(rng.randint(1, 12))) for i in range(20)] + [(3, "t3"), (None, "t1 t1 T1"), (50, None), (51, "unheard"), (52, "t40 t41 t42")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "terms": F.lit("z")}).repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({"row": F.lit(1), "n": F.lit("z")}).repartition(3)
    got = lexical.search(docs, asked, k=k, block=block)
    assert sorted(map(tuple, got.collect()), key=repr) == ranking(rows, items, k)
    if k != 50:
        return
    assert lexical.search(none, asked).count() == 0 and lexical.search(docs, none.withColumn("item_id", F.col("doc_id"))).count() == 0
    same = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, lexical.search(odd, odd.withColumn("item_id", F.col("doc_id")), k=4).collect()), key=repr) == ranking(same, same, 4)
