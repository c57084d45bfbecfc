"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are the words of a text, as features their hashed form, first 4 to 7 and last 3 bytes.
Labels mark documents, so labelled tokens come first: a feature seen in toxic documents far
more often than its share of clean ones explains marks its tokens toxic.  A two-state chain is then
trained on those tags, in stretches of ``CHAIN`` words, by its exact likelihood gradient
(marginals of the forward-backward recursion).  Scoring runs the recursion over whole texts, one
chain each, and every token gets the marginal probability of the toxic tag.  A document's score is a logistic function of how certain its
surest token is, how many toxic tokens are expected and their share; tokens over one half are its spans.

Labels may also show by what texts of label 0 hold, so a second chain of the same kind learns the words that
speak for it.  The logistic function is fitted on texts that neither chain was trained on (``FOLDS``), and
the second chain scores only if it makes that fit better.

Training runs on the driver over a bounded sample of labelled rows; scoring is one scan in
which whole texts count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import fold, pieces, table, two_columns
from .quality import labelled

CHAIN, BITS, PREFIXES = 64, 18, (4, 5, 6, 7)
KINDS = 2 + len(PREFIXES)
#: How many times as common in documents of its label a telling feature is; windows with tags that a fit takes; folds and least gain a text of the document layer.
TIMES, WINDOWS, FOLDS, GAIN = (20, 10, 5, 3, 2), 2000, 2, 0.005
SCORED = pa.schema([("id", pa.int64()), ("score", pa.float64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
SCORED_SQL = "id long, score double, starts array<long>, ends array<long>"
_EDGE = np.zeros(256, bool)
_EDGE[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """KINDS hashed features of each word, its start and end byte without punctuation around it, and the texts' word offsets."""
    start, end, word_at = W.spans(data, at)
    for _ in range(3):  # up to three marks on either side
        trim = (end - start > 1) & _EDGE[data[np.maximum(end - 1, 0)]] if len(end) else np.zeros(0, bool)
        end = end - trim
        trim = (end - start > 1) & _EDGE[data[start]] if len(end) else trim
        start = start + trim
    parts = [(start, end), *((start, np.minimum(start + k, end)) for k in PREFIXES), (np.maximum(end - 3, start), end)]
    if not len(start):
        return np.zeros((0, KINDS), np.int32), start, end, word_at
    cols = [((W.mix(W.hashes(data, a, b) + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int32)) for k, (a, b) in enumerate(parts)]
    return np.column_stack(cols), start, end, word_at


def _windows(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and number of each window of at most ``CHAIN`` words, in order, for chains of at least one word."""
    n = -(-size // CHAIN)
    rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(first, n) + CHAIN * rank
    return start, np.minimum(CHAIN, np.repeat(first + size, n) - start), rank


def chains(word_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of each text that has words."""
    size = np.diff(word_at)
    return word_at[:-1][size > 0], size[size > 0]


def _carried(odds: np.ndarray, move: np.ndarray, first: np.ndarray, size: np.ndarray, rank: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Messages that enter each window from the left and from the right.

    ``first`` and ``size`` are in decreasing length, ``live`` counts the windows longer than each
    step, and ``rank`` is each window's number in its chain; the product of a window's transition
    matrices carries messages over it in one step, so chains of any length take a few array steps a word of a window.
    """
    n = len(first)
    left, right = np.ones((n, 2)), np.ones((n, 2))
    if not rank.any():
        return left, right
    p = np.tile(np.eye(2), (n, 1, 1))
    for t, m in enumerate(live.tolist()):
        q = p[:m] @ move
        if not t:
            q = np.where(rank[:m, None, None] > 0, q, p[:m])  # nothing comes before a chain's first word
        q[:, :, 1] *= odds[first[:m] + t][:, None]
        p[:m] = q / q.sum(axis=(1, 2), keepdims=True)
    where = np.argsort(first, kind="stable")  # windows in order of their words: a chain's follow each other
    starts = np.flatnonzero(rank[where] == 0)
    count = np.diff(np.append(starts, n))
    long = np.argsort(-count, kind="stable")
    starts, count = starts[long], count[long]
    most = int(count[0])
    more = np.searchsorted(-count, -np.arange(most), side="left")  # chains of more than r windows
    for r in range(1, most):
        at = where[starts[: more[r]] + r - 1]
        m = (left[at][:, :, None] * p[at]).sum(axis=1)
        left[where[starts[: more[r]] + r]] = m / m.sum(axis=1, keepdims=True)
    for r in range(most - 1, 0, -1):
        at = where[starts[: more[r]] + r]
        m = (p[at] * right[at][:, None, :]).sum(axis=2)
        right[where[starts[: more[r]] + r - 1]] = m / m.sum(axis=1, keepdims=True)
    return left, right


def marginals(emission: np.ndarray, first: np.ndarray, size: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of tag 1 of each word, and expected counts of the four transitions, of chains (one word at least) with log-odds ``emission``."""
    out, pairs = np.zeros(len(emission)), np.zeros((2, 2))
    if not len(first):
        return out, pairs
    first, size, rank = _windows(first, size)
    order = np.argsort(-size, kind="stable")
    first, size, rank = first[order], size[order], rank[order]
    steps = int(size[0])
    live = np.searchsorted(-size, -np.arange(steps), side="left")  # windows longer than t
    odds = np.exp(np.clip(emission, -30, 30))
    move = np.exp(trans)
    left, right = _carried(odds, move, first, size, rank, live)
    later = rank > 0
    f, forward, scale = None, [], []

    def add(f0, f1, x0, x1):
        mass = np.stack([f0 * move[0, 0] * x0, f0 * move[0, 1] * x1, f1 * move[1, 0] * x0, f1 * move[1, 1] * x1])
        pairs[:] += (mass / mass.sum(axis=0)).sum(axis=1).reshape(2, 2)

    for t in range(steps):
        o = odds[first[: live[t]] + t]
        f0, f1 = (left[:, 0], left[:, 1]) if f is None else (f[0][: live[t]], f[1][: live[t]])
        a0, a1 = f0 * move[0, 0] + f1 * move[1, 0], (f0 * move[0, 1] + f1 * move[1, 1]) * o
        if f is None:
            a0, a1 = np.where(later, a0, 1.0), np.where(later, a1, o)
        z = a0 + a1
        f = (a0 / z, a1 / z)
        forward.append(f)
        scale.append(z)
    b0, b1 = right[:, 0].copy(), right[:, 1].copy()
    for t in range(steps - 1, -1, -1):
        n = live[t]
        if t + 1 < steps:
            m = live[t + 1]
            o, z = odds[first[:m] + t + 1], scale[t + 1]
            x0, x1 = b0[:m] / z, b1[:m] * o / z
            add(forward[t][0][:m], forward[t][1][:m], x0, x1)
            b0[:m], b1[:m] = move[0, 0] * x0 + move[0, 1] * x1, move[1, 0] * x0 + move[1, 1] * x1
        p0, p1 = forward[t][0] * b0[:n], forward[t][1] * b1[:n]
        out[first[:n] + t] = p1 / (p0 + p1)
    if later.any():
        add(left[later, 0], left[later, 1], b0[later], b1[later] * odds[first[later]])
    return out, pairs


class Chain:
    """Feature weights and transitions of a chain whose tag 1 marks words that speak for label 1."""

    def __init__(self, f: np.ndarray, word_at: np.ndarray, y: np.ndarray, cells: tuple[np.ndarray, np.ndarray], rounds: int = 25, rate: float = 0.4, seed: int = 11):
        self.w, self.bias, self.trans = np.zeros(1 << BITS), -6.0, np.zeros((2, 2))
        if not len(f) or not 0 < y.sum() < len(y):
            return
        tag = self._tags(f, y, *cells)
        first, size, _ = _windows(*chains(word_at))
        hot = np.add.reduceat(tag, first) > 0
        rng = np.random.default_rng(seed)
        warm = rng.permutation(np.flatnonzero(hot))[:WINDOWS]
        cold = rng.permutation(np.flatnonzero(~hot))[: 3 * len(warm) + 500]
        pick = np.sort(np.concatenate([warm, cold]))
        at = np.concatenate([[0], np.cumsum(size[pick])])
        rows = np.arange(at[-1]) + np.repeat(first[pick] - at[:-1], size[pick])
        self._fit(f[rows], tag[rows].astype(float), at[:-1], size[pick], rounds, rate)

    @staticmethod
    def _tags(f: np.ndarray, y: np.ndarray, of: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Which words the document labels mark.

        Candidates are features in three toxic documents at least and 20 times as common there as in
        clean ones.  The one in most toxic documents not yet explained is taken, again and again
        while it explains three more; so what merely goes along with toxic words, as in copies of
        one document, stays out.  Candidates in 3 % of the toxic documents need no such test.  While half of
        the toxic documents are not explained, features less telling become candidates.
        """
        n1, n0 = y.sum(), len(y) - y.sum()
        toxic = y[of] == 1
        in1, in0 = np.bincount(key[toxic], minlength=1 << BITS + 3), np.bincount(key[~toxic], minlength=1 << BITS + 3)
        taken, free = np.zeros(1 << BITS + 3, bool), np.ones(len(y), bool)
        for times in TIMES:
            good = (in1 >= 3) & (in1 / n1 > times * (in0 + 0.5) / n0)
            taken |= good & (in1 >= max(5, 0.03 * n1))
            keep = toxic & good[key]
            some, own = of[keep], key[keep]
            free[some[taken[own]]] = False
            while True:
                left = np.bincount(own[free[some]], minlength=1 << BITS + 3)
                best = int(left.argmax())
                if left[best] < 3:
                    break
                taken[best] = True
                free[some[own == best]] = False
            if free[y == 1].mean() < 0.5:
                break
        return np.any([taken[f[:, k].astype(np.int64) << 3 | k] for k in range(KINDS - 1)], axis=0)

    def _emission(self, f: np.ndarray) -> np.ndarray:
        out = np.full(len(f), self.bias)
        for k in range(KINDS):
            out += self.w[f[:, k]]
        return out

    def _fit(self, f, tag, first, size, rounds, rate):
        chain_end = np.zeros(len(tag), bool)
        chain_end[first + size - 1] = True
        inner = ~chain_end[:-1]
        seen = np.zeros((2, 2))
        np.add.at(seen, (tag[:-1][inner].astype(int), tag[1:][inner].astype(int)), 1)
        grad2, t2, b2 = np.full(1 << BITS, 1e-6), np.full((2, 2), 1e-6), 1e-6
        for _ in range(rounds):
            p, pairs = marginals(self._emission(f), first, size, self.trans)
            err = tag - p
            g = np.bincount(f.ravel(), np.repeat(err, KINDS), 1 << BITS) - 0.05 * self.w
            grad2 += g * g
            self.w += rate * g / np.sqrt(grad2)
            gt = seen - pairs
            t2 += gt * gt
            self.trans += 0.3 * rate * gt / np.sqrt(t2)
            b2 += err.sum() ** 2
            self.bias += rate * err.sum() / np.sqrt(b2)

    def summary(self, f: np.ndarray, word_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of the words; log-odds of the surest one, log of 1 + those expected and their share, of each text."""
        p = marginals(self._emission(f), *chains(word_at), self.trans)[0]
        top, total, size = np.full(len(word_at) - 1, 1e-6), np.zeros(len(word_at) - 1), np.diff(word_at)
        some = np.flatnonzero(size)
        if len(some):
            top[some] = np.maximum(np.maximum.reduceat(p, word_at[some]), 1e-6)
            total[some] = np.add.reduceat(p, word_at[some])
        top = np.minimum(top, 1 - 1e-6)
        return p, np.column_stack([np.log(top / (1 - top)) / 5, np.log1p(total), 10 * total / (size + 10)])


class Model(Chain):
    """The chain of words that speak for label 1, one of those that speak for label 0 if it helps, and the document layer."""

    def __init__(self, f: np.ndarray, word_at: np.ndarray, y: np.ndarray, rounds: int = 25, rate: float = 0.4, seed: int = 11):
        of, key = _cells(f, word_at)
        super().__init__(f, word_at, y, (of, key), rounds, rate, seed)
        self.against, self.doc = None, np.array([np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), 0.0, 0.0, 0.0])
        if not len(f) or not 0 < y.sum() < len(y):
            return
        part = np.random.default_rng(seed).permutation(len(y)) % FOLDS
        x = np.ones((len(y), 7))
        for k in range(FOLDS):  # the layer learns from texts that the chains have not seen
            seen = part != k
            rest, own = (_chosen(f, word_at, np.flatnonzero(m)) for m in (seen, ~seen))
            cells = (np.cumsum(seen) - 1)[of[seen[of]]], key[seen[of]]
            for at, label in ((1, y), (4, 1 - y)):
                x[~seen, at : at + 3] = Chain(*rest, label[seen], cells, rounds, rate, seed).summary(*own)[1]
        self.doc, loss = _logistic(x[:, :4], y)
        both, less = _logistic(x, y)
        if less < loss - GAIN * len(y):
            self.doc, self.against = both, Chain(f, word_at, 1 - y, (of, key), rounds, rate, seed)

    def score(self, data: np.ndarray, at: np.ndarray):
        """Document scores, and text number, start and end byte of each toxic token."""
        f, start, end, word_at = features(data, at)
        p, x = self.summary(f, word_at)
        x = [np.ones((len(x), 1)), x] + ([self.against.summary(f, word_at)[1]] if self.against else [])
        bad = np.flatnonzero(p > 0.5)
        doc = np.searchsorted(word_at, bad, side="right") - 1
        return 1 / (1 + np.exp(-(np.hstack(x) @ self.doc))), doc, start[bad] - at[doc], end[bad] - at[doc]


def _cells(f: np.ndarray, word_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text with each of its features once; endings are left out, as they are no evidence alone."""
    doc = np.repeat(np.arange(len(word_at) - 1), np.diff(word_at))
    own = []
    for k in range(KINDS - 1):
        cell = np.sort(doc << BITS + 3 | f[:, k].astype(np.int64) << 3 | k)
        own.append(cell[np.append(True, cell[1:] != cell[:-1])[: len(cell)]])
    cell = np.concatenate(own)
    return cell >> BITS + 3, cell & (1 << BITS + 3) - 1


def _chosen(f: np.ndarray, word_at: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and word offsets of some of the texts."""
    size = np.diff(word_at)[docs]
    at = np.concatenate([[0], np.cumsum(size)])
    return f[np.arange(at[-1]) + np.repeat(word_at[docs] - at[:-1], size)], at


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights by Newton steps with a ridge, and the loss."""
    out, ridge = np.zeros(x.shape[1]), 0.1
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(x @ out, -30, 30)))
        out -= np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + ridge * np.eye(len(out)), x.T @ (q - y) + ridge * out)
    z = x @ out
    return out, float(np.sum(np.logaddexp(0, z) - y * z))


def train(docs: DataFrame, labels: DataFrame, *, target: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = 3000, most_bytes: int = 32 << 20) -> Model:
    """Fit on at most ``most`` distinct labelled rows and ``most_bytes`` of their texts; their features alone reach the driver."""

    def run(batches):
        for batch, data, at in pieces(batches):
            f, _, _, word_at = features(data, at)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "y": batch.column("y"), "f": pa.array([f[a:b].tobytes() for a, b in zip(word_at, word_at[1:])], pa.binary())})

    got = sorted((r.id, r.y, bytes(r.f)) for r in labelled(docs, labels, target, most, most_bytes, id_col, text_col).mapInArrow(run, "id long, y int, f binary").toLocalIterator())
    f = np.frombuffer(b"".join(r[2] for r in got), np.int32).reshape(-1, KINDS)
    return Model(f, np.concatenate([[0], np.cumsum([len(r[2]) // (4 * KINDS) for r in got])]).astype(np.int64), np.array([r[1] for r in got], float))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, starts, ends) of every row: probability of label 1, and the toxic tokens' code points.

    Null counts as empty and, like any text without words, scores by the share of toxic labels and
    no evidence; ids may be null or repeat; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights, whatever the data

    def run(batches):
        for batch, data, at in pieces(batches):
            p, doc, start, end = shared.value.score(data, at)
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
            by = np.argsort(doc, kind="stable")
            size = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(p)))]), pa.int32())
            spans = (points[at[doc] + x][by] - points[at[doc]][by] for x in (start, end))
            yield table(SCORED, batch.column("id"), p, *(pa.ListArray.from_arrays(size, pa.array(x, SCORED.field("starts").type.value_type)) for x in spans))

    return two_columns(docs, id_col, text_col).mapInArrow(run, SCORED_SQL)


def op7_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of the whole ``documents`` table, learned from ``labels.toxic`` outside fold 0 of 5."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.filter(fold("doc_id", 5) != 0))
    got = score(docs, model).withColumnRenamed("id", "doc_id")
    return got.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "starts", "ends")
