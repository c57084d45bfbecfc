"""Benchmark passages in documents, edited copies too: q-gram lemma filter, then banded alignment.

Texts are compared lower-cased, with each run of other characters than letters and digits as one
space.  Items are cut into overlapping segments of at most ``SEGMENT`` characters.  A segment of
length m within e edits of a document's region shares at least ``m + 1 - q * (e + 1)`` q-grams
with it (the q-gram lemma), all on diagonals that differ by e at most.  Stretches of a document
with fewer hits of any segment than that within a region's length are passed over; in the rest,
hits are counted in diagonal bands of width 2w that start every w > e; bands that reach the bound are the only
regions aligned, and a band's alignment needs only the diagonals of the band and e on each side.

A part of an item need not cover a segment: every run of ``RUN`` characters of an item, wherever it
starts, is looked up by a hash of its q-grams and compared with the document.  Items of fewer than
``LEAST`` characters are found as they stand, as whole words.

The different texts of the items are read by the driver in blocks of about ``BLOCK_BYTES`` and sent to
the executors.  A task meets one block after another with about ``HELD_BYTES`` of documents, so it holds
one index at a time, and the postings of ``POSTINGS`` hits: one scan of the documents and no shuffle,
whatever the sizes.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import pieces, table, two_columns
from .words import LOWER, mix

Q, SEGMENT, STRIDE, LEAST, BLOCK_BYTES = 8, 120, 60, 24, 1 << 20
HELD_BYTES = 32 << 20  # of documents that meet a block at once, if there are several
POSTINGS = 1 << 21  # of the hits in a text that are spread out at once
RUN = 50  # the shortest exact part of a longer item that counts
CELL = 16  # width w of the half-bands; over the largest number of edits
FOUND = pa.schema([("id", pa.int64()), ("item_id", pa.int64()), ("segments", pa.int32()), ("of", pa.int32()), ("edits", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
FOUND_SQL = "id long, item_id long, segments int, of int, edits int, start long, end long"

_KEEP = np.zeros(256, bool)
_KEEP[48:58] = _KEEP[97:123] = True
_KEEP[128:] = True


def normal(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes, their offsets by text, and the place in ``data`` that each came from."""
    if not len(data):
        return data, at, np.zeros(0, np.int64)
    low = LOWER[data]
    upper = (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[:-1] == 0xC3) & (low[1:] != 0x97)
    low[1:][upper] += 0x20
    white = ~_KEEP[low]
    low[white] = 32
    before = np.ones(len(low), bool)
    before[1:] = white[:-1]
    before[at[:-1][at[:-1] < len(low)]] = True
    kept = np.flatnonzero(~(white & before))
    return low[kept], np.searchsorted(kept, at), kept


_PLACES = [*range(0, RUN - Q, Q), RUN - Q]  # of the q-grams that cover a run


def _grams(body: np.ndarray | bytes) -> np.ndarray:
    return np.ndarray(max(0, len(body) - Q + 1), "<u8", body, strides=(1,)) if len(body) >= Q else np.zeros(0, np.uint64)


def _runs(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the run that starts at each place."""
    h = np.zeros(len(at), np.uint64)
    for o in _PLACES:
        h = mix(h + grams[at + o])
    return h


def _word_edges(body: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a word may start or end before each byte (or at the end): beside a space, a text's edge or a character of three bytes or more."""
    free = np.zeros(len(body) + 4, bool)
    space, wide = np.flatnonzero(body == 32), np.flatnonzero(body >= 0xE0)
    free[space] = free[space + 1] = free[wide] = free[ends] = True
    free[np.minimum(wide + 3 + (body[wide] >= 0xF0), len(body))] = True
    return free[: len(body) + 1]


class Index:
    """The segments of a block of items, their q-grams, runs and short items."""

    def __init__(self, items: list[tuple[int, str | None]], rate: float):
        self.items, self.segments, self.edits, self.owner, self.of = [i for i, _ in items], [], [], [], []
        bodies, short = [], {}
        for k, (_, text) in enumerate(items):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            body = normal(raw, np.array([0, len(raw)]))[0].tobytes().rstrip()
            starts = [0] if len(body) <= SEGMENT else [*range(0, len(body) - SEGMENT, STRIDE), len(body) - SEGMENT]
            starts = starts if len(body) >= LEAST else []
            self.of.append(max(len(starts), min(len(body), 1)))
            if starts:
                bodies.append((k, body))
            elif body:
                short.setdefault(len(body), {}).setdefault(body, []).append(k)
            for a in starts:
                s = body[a : a + SEGMENT]
                self.segments.append(s)
                self.owner.append(k)
                self.edits.append(max(0, min(int(rate * len(s)), (len(s) + 1) // Q - 2, CELL - 1)))
        self.bound = np.array([len(s) + 1 - Q * (e + 1) for s, e in zip(self.segments, self.edits)], np.int64)
        kinds = [(-(-len(s) // 24), len(s) + e, b) for s, e, b in zip(self.segments, self.edits, self.bound.tolist())]
        self.classes = [(max(n for c, n, _ in kinds if c == kind), min(b for c, _, b in kinds if c == kind)) for kind in sorted({c for c, _, _ in kinds})]
        grams = [np.ndarray(len(s) - Q + 1, "<u8", s, strides=(1,)) for s in self.segments]
        every = np.concatenate([*grams, np.zeros(0, np.uint64)])
        seg = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        pos = np.concatenate([*[np.arange(len(g)) for g in grams], np.zeros(0, np.int64)])
        order = np.argsort(every, kind="stable")
        self.seg, self.pos = seg[order].astype(np.int64), pos[order].astype(np.int64)
        self.keys, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.spread(self.keys)] = True
        self.short = [(n, np.array(sorted(x), f"S{n}"), [x[b] for b in sorted(x)]) for n, x in sorted(short.items())]
        longer = [(k, body) for k, body in bodies if len(body) >= RUN]
        self.text = np.frombuffer(b"".join(body for _, body in longer), np.uint8)
        ends = np.cumsum([0] + [len(body) for _, body in longer])
        run_at = np.concatenate([*[np.arange(a, b - RUN + 1) for a, b in zip(ends[:-1], ends[1:])], np.zeros(0, np.int64)])
        hashes = _runs(_grams(self.text), run_at)
        order = np.argsort(hashes, kind="stable")
        self.run_at = run_at[order]
        self.run_item = np.array([k for k, _ in longer], np.int64)[np.searchsorted(ends, self.run_at, side="right") - 1] if len(run_at) else run_at
        self.runs, first = np.unique(hashes[order], return_index=True)
        self.run_first = np.append(first, len(order))

    @staticmethod
    def spread(v: np.ndarray) -> np.ndarray:
        return (v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def hits(self, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the items' q-grams in a text, and their numbers."""
        if len(body) < Q or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        grams = _grams(body)
        at = np.flatnonzero(self.bits[self.spread(grams)])
        own = grams[at]
        k = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        same = self.keys[k] == own
        return at[same], k[same]

    def exact(self, body: np.ndarray, ends: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, start, end) from the first to the last run of each item in each text; ``at`` are the places of hits."""
        if not len(self.runs) or not len(at):
            return []
        hit = np.zeros(len(body) + RUN, bool)
        hit[at] = True
        for o in reversed(_PLACES[1:]):
            at = at[hit[at + o]]
        text = np.searchsorted(ends, at, side="right") - 1
        inside = at + RUN <= ends[text + 1]
        at, text = at[inside], text[inside]
        grams, own = _grams(body), _grams(self.text)
        h = _runs(grams, at)
        k = np.minimum(np.searchsorted(self.runs, h), len(self.runs) - 1)
        same = self.runs[k] == h
        at, text, k = at[same], text[same], k[same]
        if not len(at):
            return []
        size = self.run_first[k + 1] - self.run_first[k]
        stops = np.cumsum(size)
        post = np.arange(stops[-1]) + np.repeat(self.run_first[k] - (stops - size), size)
        at, text = np.repeat(at, size), np.repeat(text, size)
        same = np.logical_and.reduce([grams[at + o] == own[self.run_at[post] + o] for o in _PLACES])
        at, key = at[same], text[same] * len(self.items) + self.run_item[post[same]]
        order = np.lexsort((at, key))
        at, key = at[order], key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(key)) - 1
        return [(int(x) // len(self.items), int(x) % len(self.items), int(a), int(b) + RUN) for x, a, b in zip(key[first], at[first], at[last])]

    def whole(self, body: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, start, end) of each place where an item of fewer than ``LEAST`` characters stands as whole words."""
        out: list[tuple[int, int, int, int]] = []
        if not self.short or not len(body):
            return out
        free = _word_edges(body, ends)
        starts = np.flatnonzero(free[:-1] & (body != 32))
        text = np.searchsorted(ends, starts, side="right") - 1
        for n, keys, owners in self.short:
            fits = starts + n <= ends[text + 1]
            at, d = starts[fits], text[fits]
            good = free[at + n]
            at, d = at[good], d[good]
            if not len(at):
                continue
            words = np.ndarray(len(body) - n + 1, f"S{n}", body, strides=(1,))[at]
            k = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
            for i in np.flatnonzero(keys[k] == words).tolist():
                out += [(int(d[i]), item, int(at[i]), int(at[i]) + n) for item in owners[k[i]]]
        return out

    def bands(self, body: np.ndarray, hits: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int]]:
        """(segment, first diagonal) of each band of 2 * CELL diagonals with enough shared q-grams."""
        at, k = self.hits(body) if hits is None else hits
        if not len(at):
            return []
        close = np.zeros(len(at) + 1, np.int64)
        for length, bound in self.classes:  # so many hits lie within a region's length, or none of this class is there
            if len(at) < bound:  # as in a last piece of a few words
                continue
            i = np.flatnonzero(at[bound - 1 :] - at[: len(at) - bound + 1] < length)
            np.add.at(close, i, 1)
            np.add.at(close, i + bound, -1)
        dense = np.cumsum(close[:-1]) > 0
        at, k = at[dense], k[dense]
        size = self.first[k + 1] - self.first[k]
        if not len(size):
            return []
        ends = np.cumsum(size)
        rows = (len(body) + SEGMENT) // CELL + 3
        cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] + POSTINGS, POSTINGS), side="right"))

        def spread_out(a, b):
            n = size[a:b]
            post = np.arange(n.sum()) + np.repeat(self.first[k[a:b]] - (ends[a:b] - n - (ends[a - 1] if a else 0)), n)
            seg = self.seg[post]
            return seg, seg * rows + (np.repeat(at[a:b], n) - self.pos[post] + SEGMENT) // CELL

        ranges = [(int(a), int(b)) for a, b in zip(np.append(0, cuts), np.append(cuts, len(size))) if a < b]
        parts = [spread_out(*ranges[0])] if len(ranges) == 1 else None
        slot = lambda x: (x * 0x9E3779B1) & 0xFFFFF  # noqa: E731  sums over slots are at least the true counts
        count = np.zeros(1 << 20, np.int64)
        for _, key in parts or (spread_out(*x) for x in ranges):
            count += np.bincount(slot(key), minlength=1 << 20)
        kept = []
        for seg, key in parts or (spread_out(*x) for x in ranges):
            near = count[slot(key)] + np.maximum(count[slot(key + 1)], count[slot(key - 1)]) >= self.bound[seg]
            kept.append(key[near])
        key, n = np.unique(np.concatenate(kept), return_counts=True)
        if not len(key):
            return []
        true = dict(zip(key.tolist(), n.tolist()))
        out = []
        for x in {y for k_ in true for y in (k_ - 1, k_)}:
            if true.get(x, 0) + true.get(x + 1, 0) >= self.bound[x // rows]:
                out.append((x // rows, (x % rows) * CELL - SEGMENT))
        return out


def align(segment: bytes, region: bytes, low: int, high: int, edits: int) -> tuple[int, int]:
    """(fewest edits, end) of the segment against any part of the region, on diagonals from ``low`` to ``high`` and ``edits`` beyond."""
    low, high = low - edits, high + edits
    width, n, m = high - low + 1, len(region), len(segment)
    left = max(0, -low)
    wide = np.full(left + max(n, high + m) + 1, -1, np.int16)  # place left + p holds the region's byte p
    wide[left : left + n] = np.frombuffer(region, np.uint8)
    j, ramp, none = np.arange(low, high + 1), np.arange(width), 1 << 20
    rows = np.full(width + 1, none)  # the last stands for the diagonal beyond
    row = rows[:width]
    row[:] = np.where((j >= 0) & (j <= n), 0, none)
    for i, ch in enumerate(segment, 1):
        at = left + low + i - 1
        step = np.minimum(row + (wide[at : at + width] != ch), rows[1:] + 1)
        row[:] = np.minimum.accumulate(step - ramp) + ramp
        if i <= -low or high + i > n:
            row[(j + i < 0) | (j + i > n)] = none
    best = int(row.argmin())
    return int(row[best]), int(j[best] + len(segment))


def find_passages(index: Index, data: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int, int, int]]:
    """(text, item, segments, of, edits, start, end) for each text and item with a segment or a run in it; offsets are bytes of the text."""
    body, ends, source = normal(data, at)
    found: dict[tuple[int, int], list] = {}
    done: set[tuple[int, int]] = set()
    hits = index.hits(body)
    for seg, low in sorted(index.bands(body, hits)):
        s, e = index.segments[seg], index.edits[seg]
        docs = np.searchsorted(ends, [max(low, 0), min(low + 2 * CELL + len(s) // 2, len(body) - 1)], side="right") - 1
        for d in range(int(docs[0]), int(docs[1]) + 1):
            if (d, seg) in done:
                continue
            a, b = int(ends[d]), int(ends[d + 1])
            a, b = max(a, low - e), min(b, low + 2 * CELL + len(s) + e)
            if b - a < len(s) - e:
                continue
            region = body[a:b].tobytes()
            if (hit := region.find(s)) >= 0:
                n, start, end = 0, hit, hit + len(s)
            else:
                n, end = align(s, region, low - a, low - a + 2 * CELL, e)
                if n > e:
                    continue
                back = region[:end][::-1]
                start = end - align(s[::-1], back, -2 * e, 2 * e, e)[1]
            done.add((d, seg))
            entry = found.setdefault((d, index.owner[seg]), [0, 0, 1 << 60, 0])
            entry[0] += 1
            entry[1] = max(entry[1], n)
            entry[2] = min(entry[2], int(source[a + max(0, start)]))
            entry[3] = max(entry[3], int(source[a + end - 1]) + 1)
    exact, whole = index.exact(body, ends, hits[0]), index.whole(body, ends)
    for n, (d, k, start, end) in enumerate([*exact, *whole]):
        entry = found.setdefault((d, k), [0, 0, 1 << 60, 0])
        entry[0] = entry[0] if n < len(exact) else 1
        entry[2] = min(entry[2], int(source[start]))
        entry[3] = max(entry[3], int(source[end - 1]) + 1)
    return [(d, k, x[0], index.of[k], x[1], x[2] - int(at[d]), x[3] - int(at[d])) for (d, k), x in sorted(found.items())]


def _blocks(bench: DataFrame) -> list[bytes]:
    """The different texts and the ids of each, as pickled blocks: [((id, ...), text), ...]; equal texts meet the documents once."""
    out, block, size, ids, last = [], [], 0, [], None
    for i, text in bench.orderBy("text", "id").toLocalIterator():
        if ids and text == last:
            ids.append(i)
            continue
        if ids:
            block.append((tuple(ids), last))
            size += len(last or "")
        if block and size + len(text or "") > BLOCK_BYTES:
            out.append(pickle.dumps(block))
            block, size = [], 0
        ids, last = [i], text
    if ids:
        block.append((tuple(ids), last))
    return [*out, pickle.dumps(block)]


def _held(batches, several: bool):
    """Lists of batches with about ``HELD_BYTES`` in all; single ones if there is one block of items."""
    own, size = [], 0
    for batch in batches:
        own.append(batch)
        size += batch.nbytes
        if not several or size >= HELD_BYTES:
            yield own
            own, size = [], 0
    if own:
        yield own


def _indexes(blocks: list[bytes], rate: float):
    """A function that gives the index of each block in turn, one at a time; that of a single block is kept."""
    if len(blocks) > 1:
        return lambda: (Index(pickle.loads(b), rate) for b in blocks)
    only = [Index(pickle.loads(blocks[0]), rate)]
    return lambda: only


def contaminated(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = 0.075) -> DataFrame:
    """(id, item_id, segments, of, edits, start, end): the documents that hold part of an item.

    ``segments`` of the item's ``of`` segments lie in the document, with at most ``edits`` edits
    each, between the code points ``start`` and ``end``; so do exact runs of ``RUN`` bytes or more
    of it, which stand alone if ``segments`` is 0.  An item of fewer than ``LEAST`` normalised bytes is
    one segment, found as whole words.  Null and empty texts hold nothing, and nothing holds an item
    without letters and digits; rows with null or repeated ids are reported like others; other
    columns are not read; an empty table on either side gives no rows.
    """
    blocks = _blocks(two_columns(bench, item_col, item_text_col))

    def run(batches):
        indexes = _indexes(blocks, rate)
        for own in _held(batches, len(blocks) > 1):
            for index in indexes():
                for batch, data, at in pieces(iter(own), size=1 << 18):
                    rows, ids = [], None
                    for d, k, n, of, edits, a, b in find_passages(index, data, at):
                        ids = ids or batch.column("id").to_pylist()
                        text = data[at[d] : at[d] + b].tobytes()
                        start, end = len(text[:a].decode("utf8", "ignore")), len(text.decode("utf8", "ignore"))
                        rows += [(ids[d], i, n, of, edits, start, end) for i in index.items[k]]
                    for first in range(0, len(rows), 100_000):
                        yield table(FOUND, *map(list, zip(*rows[first : first + 100_000])))

    return two_columns(docs, id_col, text_col).mapInArrow(run, FOUND_SQL)


def without_passages(docs: DataFrame, bench: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = 0.075) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no part of an item."""
    ship(docs.sparkSession)
    blocks = _blocks(two_columns(bench, item_col, item_text_col))

    def run(batches):
        indexes = _indexes(blocks, rate)
        for own in _held(batches, len(blocks) > 1):
            for index in indexes():  # a document that holds part of an item meets no further block
                left = []
                for batch, data, at in pieces(iter(own), text_col, 1 << 18):
                    clean = np.ones(batch.num_rows, bool)
                    clean[[x[0] for x in find_passages(index, data, at)]] = False
                    left.append(batch.filter(pa.array(clean)))
                own = left
            yield from own

    return docs.mapInArrow(run, docs.schema)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of ``benchmark``, one row for each document and item."""
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumnRenamed("id", "doc_id")
