"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  A passage is encoded by its character make-up,
repetition and word shape; a hidden layer turns that into h.  Gated attention (Ilse et al., 2018)
weighs passages by softmax of ``w . (tanh(V h) * sigmoid(U h))``, learned from document labels
alone, and a logistic unit scores the weighted sum of the h.  Training runs on the driver over a
bounded sample of labelled rows; scoring is one scan in which whole texts count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import Store, bounded_sample, fold, near_fraction, pieces, table, two_columns

PASSAGE = 64
_CLASS = np.full(256, 5, np.int64)  # 5: bytes beyond ASCII
_CLASS[:32] = _CLASS[127] = 0
_CLASS[32] = 1
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 2, 3, 4
_PUNCT = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASS[_PUNCT] = 6 + np.arange(len(_PUNCT))
CLASSES = 6 + len(_PUNCT)
WIDTH = CLASSES + 5
SCORED = pa.schema([("id", pa.int64()), ("score", pa.float64())])


def encode(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the n + 1 offsets of the texts' passages; a text without words has one empty passage."""
    start, end, word_at = W.spans(data, at)
    hashes = W.hashes(data, start, end)
    counts = np.diff(word_at)
    own = np.maximum(1, -(-counts // PASSAGE))
    first = np.concatenate([[0], np.cumsum(own)])
    total = int(first[-1])
    doc = np.repeat(np.arange(len(counts)), counts)
    rank = np.arange(len(start)) - word_at[doc] if len(start) else np.zeros(0, np.int64)
    passage = first[doc] + rank // PASSAGE
    x = np.zeros((total, WIDTH), np.float32)
    if len(start):
        lead = np.flatnonzero(rank % PASSAGE == 0)
        size = np.diff(np.append(start[lead], len(data)))
        of_byte = np.repeat(passage[lead], size)
        body = data[start[0] :]
        x[:, :CLASSES] = np.bincount(of_byte * CLASSES + _CLASS[body], minlength=total * CLASSES).reshape(total, CLASSES)
        n = np.bincount(passage, minlength=total)
        letters = np.maximum(x[:, :CLASSES].sum(axis=1), 1)
        key = np.sort((passage.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
        distinct = np.bincount((key[np.append(True, key[1:] != key[:-1])] >> np.uint64(40)).astype(np.int64), minlength=total)
        again = np.bincount(passage[1:][(hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])], minlength=total)
        x[:, :CLASSES] = np.sqrt(x[:, :CLASSES] / letters[:, None])
        many = np.maximum(n, 1)
        x[:, CLASSES:] = np.column_stack([distinct / many, again / many, np.bincount(passage, end - start, total) / many / 10, np.log1p(n) / 4, n == 0])
    else:
        x[:, -1] = 1
    return x, first


class Model:
    """Weights of the network; documents are ragged rows of one passage matrix."""

    def __init__(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 60, rate: float = 0.01, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.std = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(WIDTH), np.ones(WIDTH))
        draw = lambda *s: rng.normal(0, s[0] ** -0.5, s)
        self.p = {"a": draw(WIDTH, hidden), "b": np.zeros(hidden), "v": draw(hidden, gate), "u": draw(hidden, gate), "w": draw(gate), "c": draw(hidden), "d": np.zeros(1)}
        if len(y) and 0 < y.mean() < 1:
            self._fit(x, first, y.astype(float), epochs, rate, rng)
        else:
            self.p["c"][:] = 0
            self.p["d"][:] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))

    def _forward(self, x, first):
        p = self.p
        x = np.clip((x - self.mean) / self.std, -6, 6)
        h = np.maximum(x @ p["a"] + p["b"], 0)
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * s) @ p["w"]
        size = np.diff(first)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first[:-1]), size))
        a = e / np.repeat(np.add.reduceat(e, first[:-1]), size)
        z = np.add.reduceat(h * a[:, None], first[:-1], axis=0)
        return x, h, t, s, a, z, 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Slope of the mean logistic loss in every weight."""
        p, size = self.p, np.diff(first)
        q, h, t, s, a, z, got = self._forward(x, first)
        err = (got - y) / len(y)
        dz = np.repeat(err[:, None] * p["c"], size, axis=0)
        da = (dz * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, first[:-1]), size))
        dt, ds = de[:, None] * p["w"] * s * (1 - t**2), de[:, None] * p["w"] * t * s * (1 - s)
        dh = (dz * a[:, None] + dt @ p["v"].T + ds @ p["u"].T) * (h > 0)
        return {"a": q.T @ dh, "b": dh.sum(axis=0), "v": h.T @ dt, "u": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ err, "d": err.sum(keepdims=True)}

    def _fit(self, x, first, y, epochs, rate, rng):
        p, m, v, step = self.p, {k: 0 for k in self.p}, {k: 0 for k in self.p}, 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(order), 256):
                docs = order[i : i + 256]
                size = np.diff(first)[docs]
                at = np.concatenate([[0], np.cumsum(size)])
                rows = np.arange(at[-1]) + np.repeat(first[docs] - at[:-1], size)
                grad = self.gradient(x[rows], at, y[docs])
                step += 1
                for k, g in grad.items():
                    g = g + 1e-4 * p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self._forward(x, first)[-1]


def labelled(docs: DataFrame, labels: DataFrame, target: str, most: int, most_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text, y) of at most ``most`` distinct labelled rows with at most ``most_bytes`` of text; rows of one id all count, null ids have no label."""
    rows = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(target).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    some = F.broadcast(bounded_sample(near_fraction(rows, "id", most), most))  # ``most`` small rows
    return bounded_sample(Store(docs.sparkSession).put(two_columns(docs, id_col, text_col).join(some, "id"), "labelled"), most, "text", most_bytes)


def train(docs: DataFrame, labels: DataFrame, *, target: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = 4000, most_bytes: int = 64 << 20) -> Model:
    """Fit on at most ``most`` distinct labelled rows and ``most_bytes`` of their texts; a document with no words trains as one empty passage."""

    def run(batches):
        for batch, data, at in pieces(batches):
            x, first = encode(data, at)
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "y": batch.column("y"),
                "x": pa.array([x[a:b].astype(np.float16).tobytes() for a, b in zip(first, first[1:])], pa.binary()),
            })

    got = sorted((r.id, r.y, bytes(r.x)) for r in labelled(docs, labels, target, most, most_bytes, id_col, text_col).mapInArrow(run, "id long, y int, x binary").toLocalIterator())
    x = np.frombuffer(b"".join(r[2] for r in got), np.float16).reshape(-1, WIDTH).astype(np.float32)
    return Model(x, np.concatenate([[0], np.cumsum([len(r[2]) // (2 * WIDTH) for r in got])]).astype(np.int64), np.array([r[1] for r in got], float))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row: the probability of label 1.  Null counts as empty; ids may be null or repeat; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches):
        for batch, data, at in pieces(batches):
            yield table(SCORED, batch.column("id"), shared.value.score(*encode(data, at)))

    return two_columns(docs, id_col, text_col).mapInArrow(run, "id long, score double")


def op2_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of the whole ``documents`` table, learned from ``labels.quality`` outside fold 0 of 5."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.filter(fold("doc_id", 5) != 0))
    got = score(docs, model).withColumnRenamed("id", "doc_id")
    return got.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
