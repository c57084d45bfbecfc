"""Language of a text by a string kernel: Nystrom features and one-versus-rest kernel ridge regression.

The kernel of two texts counts the byte n-grams (1 to ``SPECTRUM`` bytes, lower-cased, other
characters than letters and digits as one space) present in both, whatever their number,
divided by the geometric mean of their own counts; presence is kept in ``2**BITS`` hashed
places.  ``landmarks`` training texts span the feature space, and ridge regression of +1 / -1 on
the Nystrom features gives one row of weights a language, which fold with the features into a
single landmarks x languages matrix.  Scoring is two dense products a batch of texts: presence
by landmarks, kernel by weights.  Whole texts count; a row needs nothing of another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import Store, bounded_sample, fold, near_fraction, pieces, table, two_columns
from .decontam import normal

SPECTRUM, BITS = 4, 14
SCORED = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def presence(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """0/1 matrix: which hashed n-grams each text has."""
    body, ends, _ = normal(data, at)
    n = len(at) - 1
    out = np.zeros((n, 1 << BITS), np.float32)
    flat = out.reshape(-1)
    size = np.diff(ends)
    row = np.repeat(np.arange(n, dtype=np.int64) << BITS, size)
    left = np.repeat(ends[1:], size) - np.arange(len(body))  # bytes from here to the text's end
    code = np.zeros(len(body), np.uint32)
    for k in range(SPECTRUM):
        m = len(body) - k
        if m <= 0:
            break
        code = code[:m] * np.uint32(257) + body[k:].astype(np.uint32) + np.uint32(1)
        place = (code * np.uint32(0x9E3779B1) + np.uint32(k * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - BITS)
        flat[(row[:m] + place)[left[:m] > k]] = 1
    return out


class Model:
    """Landmarks, their counts, and the folded weights."""

    def __init__(self, x: np.ndarray, y: list[str], landmarks: int, ridge: float, seed: int = 5):
        self.langs = sorted(set(y))
        rng = np.random.default_rng(seed)
        of = [rng.permutation([i for i, v in enumerate(y) if v == lang and x[i].any()]) for lang in self.langs]
        turns = sorted((r, k, int(i)) for k, own in enumerate(of) for r, i in enumerate(own))  # languages in turn
        self.marks = np.ascontiguousarray(x[[i for _, _, i in turns[:landmarks]]].T)
        self.count = self.marks.sum(axis=0)
        if not self.langs or not self.marks.shape[1]:
            self.weights = np.zeros((0, len(self.langs)), np.float32)
            return
        kernel = self.kernel(x).astype(np.float64)
        value, vector = np.linalg.eigh(self.kernel(np.ascontiguousarray(self.marks.T)).astype(np.float64))
        root = vector * np.where(value > 1e-6, 1 / np.sqrt(np.maximum(value, 1e-6)), 0)
        z = np.column_stack([kernel @ root])
        target = np.where(np.array(y)[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        share = np.array([1 / max(1, y.count(v)) for v in y])[:, None]  # languages weigh alike
        own = np.linalg.solve(z.T @ (z * share) + ridge * np.eye(z.shape[1]) / len(y), z.T @ (target * share))
        self.weights = (root @ own).astype(np.float32)

    def kernel(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.marks) / np.sqrt(np.maximum(x.sum(axis=1)[:, None] * self.count[None, :], 1))

    def predict(self, data: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and lead of each text: how far its language's margin is above the mean of the others', whatever their number."""
        n = len(at) - 1
        if not len(self.weights):
            return [self.langs[0] if self.langs else "und"] * n, np.zeros(n), np.zeros(n)
        margin = np.concatenate([self.kernel(presence(data[at[i] : at[min(i + 128, n)]], at[i : i + 129] - at[i])) @ self.weights for i in range(0, n, 128)])
        p = np.exp(3 * (margin - margin.max(axis=1, keepdims=True)).astype(np.float64))
        top, k = margin.max(axis=1), len(self.langs)
        lead = top - (margin.sum(axis=1) - top) / (k - 1) if k > 1 else np.full(n, np.inf)
        return [self.langs[i] for i in margin.argmax(axis=1)], p.max(axis=1) / p.sum(axis=1), lead


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = 3000, most_bytes: int = 64 << 20, landmarks: int = 128, ridge: float = 1e-3) -> Model:
    """Fit on at most ``most`` distinct rows with a language and ``most_bytes`` of their texts; only presence bits reach the driver."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    rows = Store(docs.sparkSession).put(near_fraction(rows.filter("lang is not null and text is not null"), "id", most), "labelled")
    rows = bounded_sample(rows, most, "text", most_bytes)

    def run(batches):
        for batch, data, at in pieces(batches):
            bits = np.packbits(presence(data, at).astype(bool), axis=1)
            yield pa.RecordBatch.from_pydict({"bits": pa.array([b.tobytes() for b in bits], pa.binary()), "lang": batch.column("lang").cast(pa.string())})

    got = sorted((bytes(r.bits), r.lang) for r in rows.mapInArrow(run, "bits binary, lang string").toLocalIterator())
    x = np.unpackbits(np.frombuffer(b"".join(b for b, _ in got), np.uint8).reshape(len(got), -1 if got else (1 << BITS) // 8), axis=1).astype(np.float32)
    return Model(x, [v for _, v in got], landmarks, ridge)


def _scored(model: Model, data: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    lang, score, lead = model.predict(data, at)
    low = np.concatenate([[0], np.cumsum((data | 32) - 97 < 26)])
    for i in np.flatnonzero(low[at[1:]] == low[at[:-1]]).tolist():
        if not any(c.isalpha() for c in data[at[i] : at[i + 1]].tobytes().decode("utf8", "replace")):
            lang[i], score[i] = "und", 0.0
    return lang, score, lead


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; ``und`` and 0 for null texts and texts without a letter.

    Ids may be null or repeat; other columns are not read.  A model of no rows says ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # landmarks x 2**BITS numbers, whatever the data

    def run(batches):
        for batch, data, at in pieces(batches):
            lang, score, _ = _scored(shared.value, data, at)
            yield table(SCORED, batch.column("id"), lang, score)

    return two_columns(docs, id_col, text_col).mapInArrow(run, "id long, lang_pred string, score double")


def known(docs: DataFrame, model: Model, least: float = 0.08, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language: not ``und``, and ahead of the mean of the others by a margin of ``least`` (of about 2 for a sure one)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, data, at in pieces(batches, text_col):
            lang, _, lead = _scored(shared.value, data, at)
            yield batch.filter(pa.array([v != "und" and x >= least for v, x in zip(lang, lead)], pa.bool_()))

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the whole ``documents`` table, learned from the rows outside fold 2 of 4."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.filter(fold("doc_id", 4) != 2))
    got = identify(docs, model).withColumnRenamed("id", "doc_id")
    return got.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
