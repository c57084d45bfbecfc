"""Token output and packing, against the plain library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from rankweave.llm import castore, packing, tokens
from rankweave.llm.common import pieces
from rankweave.llm.tokens import END_ID, Encoder, default_path
from tests.conftest import SF


def plain(texts):
    return [e.ids for e in Tokenizer.from_file(default_path()).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_is_exact_on_odd_text():
    rng = random.Random(1)
    bits = ["a", " ", "\n", "é", "'s", "1", "  ", "\t", "<|endoftext|>", "\x1c", "€", "B", "\r\n", "中", " ", "\xa0", ",", ".", "...", "foo", "foo,", "foo."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(6000)]
    for keep in (50, 1_000_000):
        enc, got = Encoder(default_path(), keep), []
        for _, data, at in pieces(pa.table({"text": texts}).to_batches(), size=2000):
            got += enc.encode(data, at)
        assert all(np.array_equal(a, b) for a, b in zip(got, plain(texts)))


def test_words_of_one_hash_are_told_apart(monkeypatch):
    """With 64 hashes for all words, every text still has its own ids."""
    real = tokens._hash
    monkeypatch.setattr(tokens, "_hash", lambda *a: real(*a) & np.uint64(0x3F << 58))
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.choice([1, 3, 7, 8, 9, 15, 16]))) + rng.choice(["", ",", "."]) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    enc, got = Encoder(default_path()), []
    for _, data, at in pieces(pa.table({"text": texts}).to_batches(), size=3000):
        got += enc.encode(data, at)
    assert all(np.array_equal(a, b) for a, b in zip(got, plain(texts)))


def read(spark, docs, tmp_path):
    castore.write_store(docs, f"file://{tmp_path}/s", parts=3)
    return castore.read_digests(spark, f"file://{tmp_path}/s").toPandas().sort_values("start")


def test_store_round_trip(spark, odd, tmp_path):
    got = read(spark, odd, tmp_path)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = {}
    for (i, _), ids in zip(rows, plain([t for _, t in rows])):
        want.setdefault(i, []).append((len(ids) + 1, crc([*ids, END_ID])))
    have = {}
    for r in got.itertuples():
        have.setdefault(None if np.isnan(r.id) else int(r.id), []).append((r.n, r.crc))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    assert (got.start.to_numpy() == np.cumsum(got.n) - got.n).all()
    ids = got.id.fillna(-1).tolist()
    assert ids == sorted(ids)
    back = castore.read_documents(spark, f"file://{tmp_path}/s").toPandas()
    assert sorted((len(x), crc(x)) for x in back.ids) == sorted(x for v in want.values() for x in v)
    chunks = castore.chunks(spark, f"file://{tmp_path}/s").toPandas()
    assert chunks.key.map(bytes).is_unique and chunks.n.sum() < got.n.sum()  # copies are stored once


def test_store_of_nothing(spark, none, tmp_path):
    assert len(read(spark, none, tmp_path)) == 0


def test_damage_is_found(spark, odd, tmp_path):
    castore.write_store(odd, f"file://{tmp_path}/s", parts=2)
    chunks = castore.chunks(spark, f"file://{tmp_path}/s").collect()
    bad = [(r.key, r.n, bytes(r.data[:-1]) + bytes([r.data[-1] ^ 1])) if k == 0 else (r.key, r.n, bytes(r.data)) for k, r in enumerate(chunks)]
    spark.createDataFrame(bad, "key binary, n long, data binary").write.mode("overwrite").parquet(f"{tmp_path}/s/raw/kind=chunk")
    with pytest.raises(Exception, match="differs from its digest"):
        castore.read_digests(spark, f"file://{tmp_path}/s").collect()
    spark.createDataFrame([(r.key, r.n, bytes(r.data)) for r in chunks[1:]], "key binary, n long, data binary").write.mode("overwrite").parquet(f"{tmp_path}/s/raw/kind=chunk")
    with pytest.raises(Exception, match="missing"):
        castore.read_digests(spark, f"file://{tmp_path}/s").collect()


def test_manifest_is_held_against_the_recipes(spark, odd, tmp_path):
    """Recipes that change places, are lost or come twice, and an edited manifest, are found."""
    path = f"{tmp_path}/s"
    castore.write_store(odd, f"file://{path}", parts=2)
    castore.verify_manifest(spark, f"file://{path}")
    rows = castore.recipes(spark, f"file://{path}").orderBy("start").collect()
    schema = castore.recipes(spark, f"file://{path}").schema
    a, b = next((x, y) for x, y in zip(rows, rows[1:]) if x.part == y.part and x.n == y.n and x.root != y.root)

    def put(changed):
        spark.createDataFrame(changed, schema).write.mode("overwrite").parquet(f"{path}/recipes")
        return castore.read_digests(spark, f"file://{path}")

    own = lambda r, other: (r.part, other.id, r.start, other.n, other.root, other.digests)
    for changed, what in (
        ([own(a, b) if r == a else own(b, a) if r == b else tuple(r) for r in rows], "Merkle root"),
        ([(r.part, r.id, r.start + (r == rows[-1]), r.n, r.root, r.digests) for r in rows], "starts elsewhere"),
        (list(map(tuple, rows[1:])), "not what the manifest says"),
        (list(map(tuple, [*rows, rows[0]])), "not what the manifest says"),
    ):
        with pytest.raises(Exception, match=what):
            put(changed).collect()
    assert put(list(map(tuple, rows))).count() == len(rows)
    kind = spark.read.parquet(f"{path}/manifest").schema
    listed = spark.read.parquet(f"{path}/manifest").collect()
    for wrong, what in (({"root": b"x" * 32}, "Merkle root"), ({"first": 5}, "not what"), ({"docs": 0}, "not what")):
        spark.createDataFrame([tuple({**r.asDict(), **wrong}.values()) for r in listed], kind).write.mode("overwrite").parquet(f"{path}/manifest")
        with pytest.raises(Exception, match=what):
            castore.read_digests(spark, f"file://{path}").collect()


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50_000, 20_000).astype("<u4")
    ends = lambda x: castore.cuts(x, np.array([0, len(x)]))[0]
    cut = lambda x: {castore.digest(x[a:b].tobytes()) for a, b in zip([0, *ends(x)], ends(x))}
    whole, edited = cut(ids), cut(np.concatenate([ids[:100], ids[:1], ids[100:]]))
    assert len(whole & edited) > 0.9 * len(whole)
    sizes = np.diff([0, *ends(ids)])
    assert sizes.max() <= castore.MOST and sizes[:-1].min() >= castore.LEAST and sizes.sum() == len(ids)
    assert ends(np.zeros(5000, "<u4"))[-1] == 5000 and ends(np.zeros(0, "<u4")) == []
    both = castore.cuts(np.concatenate([ids[:7000], ids]), np.array([0, 7000, 27_000]))  # neighbours change nothing
    assert both[0] == ends(ids[:7000]) and [x - 7000 for x in both[1]] == ends(ids)


def test_joined_crc():
    rng = np.random.default_rng(2)
    parts = [rng.integers(0, 1 << 32, n, dtype=np.uint32) for n in (1, 5, 1024, 3, 700)]
    after = np.array([sum(map(len, parts[k + 1 :])) for k in range(5)])
    assert castore.joined_crc(np.array([zlib.crc32(p.tobytes()) for p in parts]), after, np.array([0, 5]))[0] == zlib.crc32(np.concatenate(parts).tobytes())


def test_merkle():
    a, b, c = b"a", b"b", b"c"
    assert castore.merkle([a]) != castore.merkle([b]) and castore.merkle([a, b, c]) != castore.merkle([a, c, b])
    assert castore.merkle([]) == castore.digest(b"")


def test_packing(spark, odd, none):
    got = packing.packed(odd, capacity=64).toPandas()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = []
    for (i, _), ids in zip(rows, plain([t for _, t in rows])):
        ids = [*ids, END_ID]
        first = (len(ids) - 1) % 64 + 1
        edges = [0, *range(first, len(ids) + 1, 64)]
        want += [(-1 if i is None else i, p, a, b - a, crc(ids[a:b])) for p, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert sorted(map(tuple, got.fillna({"doc_id": -1})[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(int).to_numpy())) == sorted(want)
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == (own.length.cumsum() - own.length).tolist() and own.length.sum() <= 64
    assert packing.packed(none).count() == 0


def test_sequences_hold_their_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    got = packing.sequences(docs).collect()
    assert all(len(r.ids) == sum(r.lengths) <= 1024 and len(r.doc_ids) == len(r.lengths) for r in got)
    assert sum(len(r.ids) for r in got) == sum(len(x) + 1 for x in plain([r.text for r in docs.collect()]))


def test_pack_is_near_the_bound_and_follows_the_rule():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 1025, 4000)
    sequence, offset = packing.pack(sizes, 1024)
    fill = np.bincount(sequence, sizes)
    assert fill.max() <= 1024 and len(fill) <= 1.02 * sizes.sum() / 1024
    order = np.lexsort((offset, sequence))
    new = np.append(True, np.diff(sequence[order]) != 0)
    run = np.cumsum(sizes[order]) - sizes[order]
    assert (offset[order] == run - np.maximum.accumulate(np.where(new, run, 0))).all()

    def brute(sizes, cap):  # sums of squares recomputed from scratch for every choice
        gaps = []
        for s in sorted(sizes, reverse=True):
            cost = {}
            for g in {g for g in gaps if g >= s}:
                left = list(gaps)
                left.remove(g)
                left.append(g - s)
                cost[g] = sum(int(c) ** 2 for c in np.unique([x for x in left if x], return_counts=True)[1])
            if cost:
                best = min(cost, key=lambda g: (cost[g], g))
                gaps.remove(best)
                gaps.append(best - s)
            else:
                gaps.append(cap - s)
        return len(gaps)

    small = rng.integers(1, 21, 120)
    assert packing.pack(small, 20)[0].max() + 1 == brute(small.tolist(), 20)
