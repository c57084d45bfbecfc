"""What a task holds at once, of whole batches of text."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from rankweave.llm import lexical, ngram, phrases, repeats


class Task:
    """Stands for a table: what an operator gives to ``mapInArrow`` is returned, to be run here."""

    sparkSession = None

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


@pytest.fixture(scope="module")
def batch():
    """19 MB of text in one batch, words drawn at random."""
    rng = np.random.default_rng(1)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(5000)]
    text = [" ".join(words[i] for i in rng.integers(0, 5000, 300)) for _ in range(9000)]
    ids = np.arange(len(text))
    return pa.RecordBatch.from_pydict({"row": ids, "id": ids, "pid": ids, "lang_hash": np.zeros(len(ids), np.int64), "text": text})


@pytest.mark.parametrize("run,most", [(lambda: lexical.term_rows(Task()), 80), (lambda: phrases.count(Task(), 8), 180), (lambda: repeats.deal(Task(), 20, 8), 90)], ids=["terms", "count", "deal"])
def test_peak_of_a_task(batch, run, most):
    list(run()(iter([batch.slice(0, 10)])))  # tables of powers
    tracemalloc.start()
    for _ in run()(iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < most


def test_meetings_are_bounded():
    """Documents of terms that many items have are met in slices, one document at least, and none is lost."""
    terms = [np.arange(k % 50, dtype=np.int64) for k in range(2000)] + [np.arange(400, dtype=np.int64)]
    rows = pa.RecordBatch.from_pydict({"id": np.arange(2001), "terms": pa.array(terms, pa.list_(pa.int64()))})
    items = np.repeat(np.arange(30), 400)
    block = lexical._Block(pa.table({"item": items, "term": np.tile(np.arange(400), 30), **{c: np.ones(12000, np.int64) for c in ("w", "most", "rest", "least")}}))
    slices = list(lexical._slices(rows, block.met, 5000))
    assert np.concatenate([s.column("id").to_numpy() for s in slices]).tolist() == list(range(2001))
    assert all(s.num_rows == 1 or block.met(s.column("terms").flatten().to_numpy()).sum() <= 5000 for s in slices) and len(slices) > 100
    assert list(lexical._slices(rows.slice(0, 0), block.met, 5000)) == []


def test_counting_gives_memory_back(batch, monkeypatch):
    """Workers live on beside those of later stages, so what a task has freed goes back when it ends."""
    calls = []
    monkeypatch.setattr(ngram, "release", lambda: calls.append(1))
    few = batch.slice(0, 100)
    rows = pa.RecordBatch.from_pydict({"text": few.column("text"), "place": few.column("id"), "block": np.zeros(100, np.int64), "part": np.zeros(100, np.int32)})
    assert sum(b.num_rows for b in ngram._count_grams(iter([rows]), 2)) == 4 and calls == [1]
