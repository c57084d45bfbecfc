"""Classifiers by held-out accuracy, and on odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.llm import langid, quality, toxicity
from rankweave.llm.common import bounded_sample, near_fraction
from tests.conftest import SF

SF1 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF1}/labels.parquet").collect()}


def test_language_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF1}/documents.parquet").select("doc_id", "lang").collect()}
    got = langid.op6_language_id(spark, SF1).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and all(0 <= r.score <= 1 for r in got)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) >= 0.98


def test_kernel_is_shared_over_geometric_mean():
    texts = [b"abc abd", b"abc xyz", b"", b"12 \xc3\x89t\xc3\xa9"]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    x = langid.presence(data, at)

    def grams(t):
        t = t.decode().lower().encode()
        return {(n, t[i : i + n]) for n in range(1, 5) for i in range(len(t) - n + 1)}

    assert x.sum(axis=1).tolist() == [len(grams(t)) for t in texts]  # no two of these few share a place
    assert (x[0] @ x[1]) == len(grams(texts[0]) & grams(texts[1]))
    alone = [langid.presence(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert all((a == b).all() for a, b in zip(x, alone))


def test_language_of_odd_rows(spark, odd, none):
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"))
    got = [(r.id, r.lang_pred, r.score) for r in langid.identify(odd, model).collect()]
    assert len(got) == odd.count()
    assert {x[0] for x in got if x[1] == "und"} == {None, 3, 4, 5, 10} and all(x[2] == 0 for x in got if x[1] == "und")
    assert langid.identify(none, model).count() == 0
    empty = langid.train(none.withColumnRenamed("id", "lang"))
    assert {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}
    kept = langid.known(odd, model, 0.0)
    assert kept.columns == odd.columns and kept.count() == sum(x[1] != "und" for x in got)
    one = langid.train(odd.selectExpr("doc_id", "text", "'en' as lang"))
    assert {r.lang_pred for r in langid.identify(odd, one).collect()} == {"en", "und"}


@pytest.mark.parametrize("query,target,least", [(quality.op2_quality_mil, "quality", 0.95), (toxicity.op7_toxicity_crf, "toxic", 0.9)])
def test_label_accuracy(spark, labels, query, target, least):
    got = query(spark, SF1).collect()
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert len(got) == 1000 and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.predicted == labels[r.doc_id][target] for r in held]) >= least
    bound = 0.3 if target == "quality" else 0.5
    assert all(r.predicted == (r.score >= bound) for r in got)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_labels_of_odd_rows(spark, odd, none, module):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = module.train(docs, labels)
    got = module.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.id, set()).add(r.score)
    assert by[3] == by[4] == by[5]  # null, empty and blank
    assert module.score(none, model).count() == 0
    for no in (labels.limit(0), labels.selectExpr("doc_id", "cast(null as int) as quality", "cast(null as int) as toxic"), labels.selectExpr("doc_id", "1 as quality", "1 as toxic")):
        scores = {r.score for r in module.score(odd, module.train(docs, no)).collect()}
        assert len(scores) == 1 and 0 < scores.pop() < 1


def test_samples_are_bounded(spark):
    one = spark.range(2000).selectExpr("1L as id", "repeat(cast(id as string), 5) as text")
    assert bounded_sample(one, 300, "text").count() == 300 and bounded_sample(one.selectExpr("cast(null as long) as id", "text"), 300, "text").count() == 300
    assert bounded_sample(one.selectExpr("id", "'same' as text"), 300, "text").count() == 1 and bounded_sample(one.limit(0), 300, "text").count() == 0
    huge = one.limit(20).union(spark.range(1).selectExpr("9L as id", "repeat('x', 5000000) as text"))
    assert bounded_sample(huge, 300, "text", 1 << 20).count() == 20
    rows = bounded_sample(one, 300, "text", 2000).collect()
    assert 0 < sum(len(r.text) for r in rows) <= 2000 and rows == bounded_sample(one.repartition(3), 300, "text", 2000).orderBy("text").collect() or len(rows) > 1
    many = spark.range(50_000)
    assert near_fraction(many, "id", 30_000).count() == 50_000 and 1500 < near_fraction(many, "id", 1000).count() < 2500


@pytest.mark.parametrize("module,target", [(quality, "quality"), (toxicity, "toxic")])
def test_training_rows_that_repeat(spark, module, target):
    """Repeated and null ids among documents and labels, and a text of some MB, bound neither the sample nor its use."""
    docs = spark.range(900).selectExpr("case when id % 3 = 0 then 7 when id % 50 = 1 then null else id end as doc_id", "concat('plain words number ', id, case when id % 2 = 0 then ' vile stuff' else ' fine' end) as text")
    docs = docs.union(spark.range(1).selectExpr("7L as doc_id", "repeat('word ', 600000) as text"))
    labels = docs.selectExpr("doc_id", f"case when text like '%vile%' then 1 else 0 end as {target}")
    assert quality.labelled(docs, labels, target, 100, 1 << 20, "doc_id", "text").count() <= 100
    model = module.train(docs, labels, most=100)
    assert module.score(docs, model).count() == 901


@pytest.mark.parametrize("ids", [1, 3, 10])
def test_few_ids_with_many_rows(spark, ids):
    """A sample is of rows whatever their ids, never an empty one while labelled rows are there."""
    rows = spark.range(100_000).selectExpr(f"id % {ids} as doc_id", "concat(case when id % 2 = 0 then 'vile stuff ' else 'plain words ' end, id) as text", "case when id % 2 = 0 then 'en' else 'de' end as lang")
    assert near_fraction(rows, "doc_id", 10).count() == 100_000 and near_fraction(rows.selectExpr("cast(null as long) as doc_id"), "doc_id", 10).count() == 100_000
    few = rows.limit(2000)
    found = langid.identify(few, langid.train(rows, most=10))
    assert {r.lang_pred for r in found.collect()} <= {"en", "de"}
    for module, target in ((quality, "quality"), (toxicity, "toxic")):
        labels = spark.range(ids).selectExpr("id as doc_id", f"1 as {target}").union(spark.range(ids).selectExpr("id", "0"))
        assert 0 < quality.labelled(rows, labels, target, 10, 1 << 20, "doc_id", "text").count() <= 10
        assert module.score(few, module.train(few, labels, most=10)).count() == 2000


@pytest.mark.parametrize("flipped", [False, True])
def test_toxicity_ranks_held_out_rows(spark, tmp_path, flipped):
    """Held-out rows of label 1 come first, whether toxic words speak for label 1 or for label 0."""
    spark.read.parquet(f"{SF1}/documents.parquet").write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.read.parquet(f"{SF1}/labels.parquet").withColumn("toxic", F.abs(F.col("toxic") - int(flipped)))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = toxicity.op7_toxicity_crf(spark, str(tmp_path)).filter("held_out").join(labels, "doc_id").select("score", "toxic").collect()
    one, zero = (np.array([r.score for r in rows if r.toxic == y]) for y in (1, 0))
    assert np.mean((one[:, None] > zero) + 0.5 * (one[:, None] == zero)) >= 0.93


def test_many_toxic_words_in_one_text(spark):
    """Offsets take time in proportion to the text, and count code points."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    model.bias += 50.0
    words = ["wört", "mot", "слово"] * 30_000
    (row,) = toxicity.score(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"), model).collect()
    at = np.cumsum([0, *(len(w) + 1 for w in words[:-1])])
    assert row.starts == at.tolist() and row.ends == [a + len(w) for a, w in zip(at.tolist(), words)]


def test_attention_gradient_against_differences():
    """What one training step moves along is the slope of the loss."""
    rng = np.random.default_rng(4)
    x, first, y = rng.normal(size=(14, quality.WIDTH)).astype(np.float64), np.array([0, 3, 4, 9, 14]), np.array([0, 1, 1, 0.0])
    m = quality.Model(x, first, y, epochs=0)
    grad = m.gradient(x, first, y)
    loss = lambda: -np.mean(y * np.log(m.score(x, first)) + (1 - y) * np.log(1 - m.score(x, first)))
    for name, g in grad.items():
        for _ in range(6):
            k = tuple(rng.integers(0, n) for n in g.shape)
            old = m.p[name][k]
            m.p[name][k] = old + 1e-5
            up = loss()
            m.p[name][k] = old - 1e-5
            down = loss()
            m.p[name][k] = old
            assert np.isclose(g[k], (up - down) / 2e-5, rtol=1e-3, atol=1e-7), (name, k)


def test_ridge_solution_of_all_landmarks():
    """With every text a landmark the Nystrom solution is that of plain kernel ridge regression with weights."""
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("abcde " if k % 2 else "defgh "), 40)).encode() for k in range(24)]
    y = ["odd" if k % 2 else "even" for k in range(24)]
    x = langid.presence(np.frombuffer(b"".join(texts), np.uint8), np.arange(25) * 40)
    ridge = 0.5
    m = langid.Model(x, y, 24, ridge)
    n = x.sum(axis=1)
    kernel = (x @ x.T) / np.sqrt(n[:, None] * n[None, :])
    target = np.where(np.array(y)[:, None] == np.array(["even", "odd"])[None, :], 1.0, -1.0)
    plain = kernel @ np.linalg.solve(kernel + ridge / 24 * 12 * np.eye(24), target)
    assert np.allclose(m.kernel(x) @ m.weights, plain, atol=1e-3)


def test_attention_gradient():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, quality.WIDTH)).astype(np.float32)
    first = np.array([0, 4, 5, 12, 20, 30])
    y = np.array([0, 1, 0, 1, 1.0])
    m = quality.Model(x, first, y, epochs=1)
    again = quality.Model(x, first, y, epochs=300)
    loss = lambda m: -np.mean(y * np.log(m.score(x, first)) + (1 - y) * np.log(1 - m.score(x, first)))
    assert loss(again) < 0.05 < loss(m)
    a = m._forward(x, first)[4]
    assert np.allclose(np.add.reduceat(a, first[:-1]), 1)


def test_marginals_against_enumeration():
    rng = np.random.default_rng(2)
    emission, trans = rng.normal(size=12), rng.normal(size=(2, 2))
    first, size = np.array([0, 5, 6]), np.array([5, 1, 6])
    p, pairs = toxicity.marginals(emission, first, size, trans)
    want, want_pairs = np.zeros(12), np.zeros((2, 2))
    for a, n in zip(first, size):
        total, mass, moves = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            tags = [(code >> k) & 1 for k in range(n)]
            s = sum(emission[a + k] * t for k, t in enumerate(tags)) + sum(trans[u, v] for u, v in zip(tags, tags[1:]))
            total += np.exp(s)
            mass += np.exp(s) * np.array(tags)
            for u, v in zip(tags, tags[1:]):
                moves[u, v] += np.exp(s)
        want[a : a + n] = mass / total
        want_pairs += moves / total
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs)


def plain_marginals(emission, trans):
    """Probability of tag 1 of each word of one chain, by the recursion over single words in logarithms."""
    n = len(emission)
    e = np.column_stack([np.zeros(n), np.clip(emission, -30, 30)])
    f, b = [e[0]], [np.zeros(2)]
    for t in range(1, n):
        f.append(np.logaddexp(f[-1][0] + trans[0], f[-1][1] + trans[1]) + e[t])
    for t in range(n - 1, 0, -1):
        m = trans + (e[t] + b[-1])[None, :]
        b.append(np.logaddexp(m[:, 0], m[:, 1]))
    s = np.array(f) + np.array(b[::-1])
    return 1 / (1 + np.exp(s[:, 0] - s[:, 1]))


def test_chains_of_any_length():
    rng = np.random.default_rng(5)
    size = np.array([1, 63, 64, 65, 128, 1000, 7, 5000, 129])
    first = np.concatenate([[3], 3 + np.cumsum(size)[:-1]])
    emission, trans = rng.normal(size=size.sum() + 3) * 3, np.array([[2.0, -1.5], [-1.0, 2.5]])
    p, pairs = toxicity.marginals(emission, first, size, trans)
    for a, n in zip(first, size):
        assert np.allclose(p[a : a + n], plain_marginals(emission[a : a + n], trans), atol=1e-9)
    assert np.isclose(pairs.sum(), (size - 1).sum())


def test_toxic_scores_against_plain_recursion(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in toxicity.score(docs, model).collect():
        data = np.frombuffer(texts[r.id].encode(), np.uint8)
        f, start, end, _ = toxicity.features(data, np.array([0, len(data)]))
        p = plain_marginals(model.w[f].sum(axis=1) + model.bias, model.trans) if len(f) else np.zeros(0)
        top, total = min(max([1e-6, *p]), 1 - 1e-6), p.sum()
        s = model.doc @ [1, np.log(top / (1 - top)) / 5, np.log1p(total)]
        assert np.isclose(r.score, 1 / (1 + np.exp(-s)), atol=1e-6)
        assert r.starts == [len(data[:a].tobytes().decode("utf8", "ignore")) for a, x in zip(start, p) if x > 0.5] or abs(p - 0.5).min() < 1e-6


def test_toxic_spans_are_words(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF1}/documents.parquet").collect()}
    found = [r for r in toxicity.op7_toxicity_crf(spark, SF1).collect() if r.starts]
    assert found
    for r in found:
        for a, b in zip(r.starts, r.ends):
            assert b > a and not any(c.isspace() for c in docs[r.doc_id][a:b])
