"""Secrets in texts and in what texts hide: a worklist of decoded layers, scanned until nothing new appears.

Three kinds of secret are looked for in the text itself.  Then every layer is decoded where it
holds percent escapes, ``\\uXXXX`` / ``\\xXX`` / numeric character references, characters that stand
for ASCII ones, or base64 runs that hold text or gzip, zlib, bzip2 or xz streams (all members, whatever
their size and characters), over line breaks and amid other characters too, or streams given as escapes; each result is
a further layer, scanned and decoded in turn.  A layer seen before in the document is not entered
again, so cycles (a gzip file that unpacks to itself) end.  A layer knows which part of its parent
each character came from and asks the parent only for hits, so a hit anywhere has offsets in the
document, in code points, end exclusive, and no span is kept for each character.

Texts are scanned whole, one row at a time; a row needs nothing of another, so the scan has no
shuffle and a lost executor repeats only its own splits.
"""

from __future__ import annotations

import binascii
import bz2
import codecs
import hashlib
import lzma
import re
import unicodedata
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import pieces, table, two_columns

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a shorter run holds no longer one
HEX = re.compile(r"[0-9a-f]{24,}")
URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
CODE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
WIDE = re.compile("[^\\x00-\\u00ff]")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Runs over line breaks; where a stream may start in a run, or in bytes; bytes of text in a run that is not text as a whole.
LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[\x20\t]*+\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}")
HEAD = re.compile(r"H4sI|Qlpo|[/_]Td6WFoA|e(?:A[E-H]|F[4-7]|J[w-z]|N[o-r])")
MAGIC = re.compile("\x1f\x8b\x08|BZh[1-9](?=1AY&SY|\x17rE8P)|\xfd7zXZ\0|x[\x01\x5e\x9c\xda]")
LATIN = re.compile("[\0-\xff]+")
STRETCH = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){12,}")
RAW = re.compile(r"(?:%|\\x|\\u00)([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,2});|&#([0-9]{1,3});|\\([abfnrtv0\\'\"])")
SHORT = dict(zip("abfnrtv0", "\a\b\f\n\r\t\v\0"))
PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\u00a0-\\ud7ff\\uf900-\\U0010ffff]+")
#: Streams unpack in pieces of so many bytes, to layers of so many characters and more up to a place that no
#: secret or code runs over; without such a place for MOST_BYTES characters, layers overlap by OVERLAP.
PIECE, LAYER, OVERLAP, MOST_BYTES = 1 << 20, 8 << 20, 1 << 20, 64 << 20
BREAK = re.compile(r"(?<=[A-Za-z.])\x20(?=[A-Za-z])|[,<>(){}\[\]|!?*$@^~`\0-\x08\x0e-\x1f\x7f]")

SPANS = pa.schema([("id", pa.int64()), ("base", pa.list_(pa.string())), ("spans", pa.list_(pa.string())), ("redacted", pa.string())])
SPANS_SQL = "id long, base array<string>, spans array<string>, redacted string"


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of each secret in the text as it stands."""
    found, low = [], text.lower()
    if any(w in low for w in ("passw", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


class _Spans:
    """Source spans of the characters of a layer, by number.

    ``step(i, side)`` gives the place in the parent layer of the first (side 0) or last (1) character
    that character ``i`` came from; a layer without parent has ``edge(i, side)`` in the document.
    """

    parent = None

    def __getitem__(self, i: int) -> tuple[int, int]:
        out = []
        for side in (0, 1):
            where, at = self, i
            while where.parent is not None:  # however deep layers are
                where, at = where.parent, where.step(at, side)
            out.append(where.edge(at, side))
        return out[0], out[1]


class _Document(_Spans):
    """Spans of the characters of the document itself."""

    def edge(self, i: int, side: int) -> int:
        return i + side


class _Edited(_Spans):
    """Spans of a layer that is its parent with parts replaced; new characters have the span of what they replace."""

    def __init__(self, parent):
        self.parent = parent
        self.begin, self.stop, self.a, self.b = (array("q") for _ in range(4))

    def step(self, i: int, side: int) -> int:
        k = bisect_right(self.begin, i) - 1
        if k < 0:
            return i
        if i < self.stop[k]:
            return self.b[k] - 1 if side else self.a[k]
        return self.b[k] + i - self.stop[k]


class _Packed(_Spans):
    """One span for all characters."""

    def __init__(self, start: int, end: int):
        self.span = start, end

    def edge(self, i: int, side: int) -> int:
        return self.span[side]


class _Base64(_Spans):
    """Spans of text that starts at byte ``at`` of what the base64 characters at ``place`` of the parent hold from number ``start`` on."""

    def __init__(self, parent, place: Sequence[int], text: str, at: int, start: int):
        self.parent, self.place, self.text, self.at, self.start, self.sizes = parent, place, text, at, start, None

    def step(self, i: int, side: int) -> int:
        i += side
        if self.text.isascii():
            at = self.at + i
        else:
            if self.sizes is None:
                code = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
                self.sizes = np.concatenate([[0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))])
            at = self.at + int(self.sizes[i])
        return int(self.place[min(len(self.place), self.start - (-at * 4 // 3)) - 1 if side else self.start + at * 4 // 3])


def _replaced(text: str, where, edits: Iterable[tuple[int, int, str]]) -> tuple[str, _Edited] | None:
    """The text with each (start, end, new) of ``edits`` done, and its spans; None if there are none."""
    out, at, size, spans = [], 0, 0, _Edited(where)
    for a, b, new in edits:
        out += [text[at:a], new]
        size += a - at
        for column, x in zip((spans.begin, spans.stop, spans.a, spans.b), (size, size + len(new), a, b)):
            column.append(x)
        size, at = size + len(new), b
    return ("".join([*out, text[at:]]), spans) if out else None


def _percent(text: str) -> Iterator[tuple[int, int, str]]:
    """Runs of percent escapes as text; bytes that are no UTF-8 stand for Latin-1 characters."""
    for m in URL.finditer(text):
        data = bytes.fromhex(m[0].replace("%", ""))
        try:
            decoded = data.decode()
        except UnicodeDecodeError:
            decoded = None
        at = m.start()
        for ch in data.decode("latin-1") if decoded is None else decoded:  # character by character, for spans as narrow as they can be
            n = 3 * (1 if decoded is None else len(ch.encode()))
            yield at, at + n, ch
            at += n


def _codes(text: str) -> Iterator[tuple[int, int, str]]:
    for m in CODE.finditer(text):
        n = int(m[4]) if m[4] else int(m[1] or m[2] or m[3], 16)
        if n < 0x110000 and not 0xD800 <= n < 0xE000:
            yield m.start(), m.end(), chr(n)


def _compatible(text: str) -> Iterator[tuple[int, int, str]]:
    """Characters that stand for printable ASCII (full-width forms, mathematical letters and the like), by compatibility normalization."""
    for m in WIDE.finditer(text):
        new = unicodedata.normalize("NFKC", m[0])
        if new != m[0] and new.isascii() and new.isprintable():
            yield m.start(), m.end(), new


def _opener(data: bytes):
    if data[:2] == b"\x1f\x8b" or data[:1] == b"\x78" and len(data) > 2 and int.from_bytes(data[:2], "big") % 31 == 0:
        return zlib.decompressobj(47)
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if data[:6] == b"\xfd7zXZ\0" else None


def _fill(data: bytes = b""):
    """``data`` and what follows, until a header's length is there; yields None for each piece it asks for."""
    while len(data) < 6 and (more := (yield)) is not None:
        data += more
    return data


def _unpacking(data: bytes = b"", rest: list[int] | None = None):
    """A coroutine that unpacks all members of a stream: it yields None to be sent the next piece (None at the end), or a piece of at most ``PIECE`` bytes.

    A member that breaks off gives what came before the fault; one that gives nothing, and what
    follows the last member, come as they are, or ``rest`` gets the size of what was read of the latter.
    """
    data = yield from _fill(data)
    while (d := _opener(data)) is not None:
        held, some = [data], False
        try:
            while not d.eof:
                out = d.decompress(data, PIECE)
                data = getattr(d, "unconsumed_tail", b"")
                if out:
                    held, some = [], True
                    yield out
                elif not d.eof and not data:
                    if not (data := (yield)):
                        break
                    held += [] if some else [data]
        except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError):
            for piece in held:
                yield piece
            while not some and (more := (yield)) is not None:
                yield more
            return
        if not d.eof:
            return
        data = d.unused_data
        if len(data) < 6:
            data = yield from _fill(data)
        data = data.lstrip(b"\0")  # padding between members
        if not data:
            data = yield from _fill()
    if rest is not None:
        rest.append(len(data))
        return
    if data:
        yield data
    while (more := (yield)) is not None:
        yield more


class _Stages:
    """A stream through any number of unpacking stages, without recursion."""

    def __init__(self, stream: Iterator[bytes], stages: Iterable = ()):
        self.stream, self.stages = stream, list(stages)

    def piece(self) -> bytes | None:
        """The next piece of the last stage; None at the end."""
        asked, given = [len(self.stages) - 1], None
        while True:
            k = asked[-1]
            if k < 0:
                out = next(self.stream, None)
            else:
                try:
                    out = self.stages[k].send(given)
                except StopIteration:
                    out = None
                else:
                    if out is None:
                        asked.append(k - 1)
                        given = None
                        continue
            asked.pop()
            if not asked:
                return out
            given = out

    def pieces(self, head: bytes = b"") -> Iterator[bytes]:
        if head:
            yield head
        while (out := self.piece()) is not None:
            yield out

    def head(self) -> bytes:
        """A header's length at least and, if what comes next is all there is, the whole; then no stage is needed any more."""
        data = b""
        while len(data) < 6 and (more := self.piece()) is not None:
            data += more
        if (more := self.piece()) is None:
            self.stream, self.stages = iter(()), []
        return data + (more or b"")


def _unpacked(stream: Iterator[bytes], rest: list[int] | None = None) -> Iterator[bytes]:
    """What all members of a packed stream unpack to."""
    return _Stages(stream, [_unpacking(rest=rest)]).pieces()


def _peeled(stream: Iterator[bytes]) -> Iterator[bytes] | None:
    """The innermost stream of streams in streams, until it is none or comes back; None if this is no stream."""
    met, stages = set(), _Stages(stream)
    head = bare = stages.head()
    while _opener(head) is not None and (key := hashlib.sha256(head).digest()) not in met:
        met.add(key)
        stages.stages.append(_unpacking(head))
        head = stages.head()
        if len(met) == 1 and head == bare:
            return None
    return stages.pieces(head) if met else None


def _cut(data, size: int = 1 << 16) -> Iterator:
    return (data[a : a + size] for a in range(0, len(data), size))


def _texts(stream: Iterator[bytes]) -> Iterator[str]:
    """The stream as texts of bounded size, cut where no secret or code runs on; other bytes than UTF-8 become replacement characters."""
    decoder, text = codecs.getincrementaldecoder("utf8")("replace"), ""
    for piece in stream:
        text += decoder.decode(piece)
        if len(text) >= LAYER:
            cut = len(text) - OVERLAP if len(text) >= MOST_BYTES else 0
            for m in BREAK.finditer(text, len(text) - 2 * OVERLAP, len(text) - OVERLAP):
                cut = m.start()
            if cut:
                yield text
                text = text[cut:]
    yield text + decoder.decode(b"", True)


def _decoded(body: str, start: int = 0) -> Iterator[bytes]:
    """The bytes of a base64 run from one of its characters on; a last character alone holds none."""
    for a in range(start, len(body), 1 << 16):
        part = body[a : a + (1 << 16)]
        part = part[:-1] if len(part) % 4 == 1 else part
        yield binascii.a2b_base64(part + "=" * (-len(part) % 4))


def _runs(layer: str) -> Iterator[tuple[str, Sequence[int]]]:
    """Base64 runs and the place of each character, those over line breaks too."""
    for m in BASE64.finditer(layer):
        yield m[0], range(m.start(), m.end())
    if "\n" in layer:
        for m in LINES.finditer(layer):
            run = np.frombuffer(m[0].encode(), np.uint8)  # the pattern has ASCII alone
            own = (run > 32).nonzero()[0]
            if len(own) >= 16:
                yield run[own].tobytes().decode(), own + m.start()


def _hidden(layer: str, where) -> Iterator[tuple[str, object]]:
    """The texts in the base64 runs of a layer.

    A run that is not text or a stream as a whole may have other characters of the alphabet around
    it, so text is looked for in all four phases, and streams wherever one may start.  A stream's
    text carries the span of its run from there on.
    """
    for run, place in _runs(layer):
        placed = lambda text, at, start: (text, _Base64(where, place, text, at, start))  # noqa: E731, B023
        body = run.rstrip("=").replace("-", "+").replace("_", "/")
        whole = b"".join(_decoded(body)) if len(body) % 4 != 1 else b""
        try:
            text = whole.decode() if _opener(whole) is None else ""
        except UnicodeDecodeError:
            text = ""
        if PLAIN.fullmatch(text):
            yield placed(text, 0, 0)
            continue
        packed = False
        for a in sorted({0, *(m.start() for m in HEAD.finditer(body))}):
            if (stream := _peeled(_decoded(body, a))) is not None:
                packed = packed or not a
                for text in _texts(stream):
                    yield text, _Packed(where[int(place[a])][0], where[int(place[-1])][1])
        for a in range(0 if not packed else 4, 4):
            for m in STRETCH.finditer(b"".join(_decoded(body, a))):
                try:
                    yield placed(m[0].decode(), m.start(), a)
                except UnicodeDecodeError:  # surrogates and the like: one character for each byte outside ASCII
                    yield placed("".join(chr(b) if b < 128 else "\x1a" for b in m[0]), m.start(), a)


def _raw(layer: str, where) -> Iterator[tuple[str, object]]:
    """The texts in streams whose bytes are given as escapes (or as characters of that number)."""
    def byte(m):
        n = int(m[3]) if m[3] else int(m[1] or m[2], 16) if m[1] or m[2] else -1
        return SHORT.get(m[4], m[4]) if n < 0 else chr(n) if n < 256 else m[0]

    if not MAGIC.search(RAW.sub(byte, layer)):
        return
    data, spans = _replaced(layer, where, ((m.start(), m.end(), new) for m in RAW.finditer(layer) if len(new := byte(m)) == 1)) or (layer, where)
    for m in MAGIC.finditer(data):
        body = data[m.start() : LATIN.match(data, m.start()).end()].encode("latin-1")
        rest, given = [], 0

        def counted(body=body):
            nonlocal given
            for part in _cut(body):
                given += len(part)
                yield part

        for _ in _unpacked(counted(), rest):
            pass
        end = given - rest[0] if rest else len(body)
        while not rest and end > 1 and spans[m.start() + end - 1][1] - spans[m.start() + end - 1][0] == 1:
            end -= 1  # a stream that breaks off ends with its last escape
        if (stream := _peeled(_cut(body[:end]))) is not None:
            for text in _texts(stream):
                yield text, _Packed(spans[m.start()][0], spans[m.start() + end - 1][1])


def _inner(layer: str, where) -> Iterator[tuple[str, object]]:
    """The layers decoded from this one."""
    for edits in (_percent(layer) if "%" in layer else (), _codes(layer) if "\\" in layer or "&#" in layer else (), () if layer.isascii() else _compatible(layer)):
        if (got := _replaced(layer, where, edits)) is not None:
            yield got
    if "%" in layer or "\\" in layer or "&#" in layer:
        yield from _raw(layer, where)
    yield from _hidden(layer, where)


def layers(text: str):
    """Every decoded layer of ``text``, with the source spans of its characters by number; the text itself is not among them."""
    key = lambda x: hashlib.sha256(x.encode("utf8", "replace")).digest()
    work, seen = [_inner(text, _Document())], {key(text)}
    while work:
        if (got := next(work[-1], None)) is None:
            work.pop()
        elif (k := key(got[0])) not in seen:
            seen.add(k)
            yield got
            work.append(_inner(*got))


def find(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base and all spans of a text (null: empty), each sorted by start, kind and end; all spans are distinct and hold the base ones."""
    text = text or ""
    base = sorted(scan(text))
    every = set(base)
    for layer, where in layers(text):
        every.update((where[a][0], kind, where[b - 1][1]) for a, kind, b in scan(layer))
    return base, sorted(every)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span (or run of overlapping spans) as ``[secret]``."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans, redacted): spans as ``kind:start:end``, and the text with all spans redacted.

    One row per row: null ids stay, null text counts as empty (and is redacted to null), other
    columns are not read.
    """

    def run(batches):
        for batch, _, _ in pieces(batches):
            rows = []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                base, every = find(text)
                name = lambda spans: [f"{KINDS[k]}:{a}:{b}" for a, k, b in spans]
                rows.append((i, name(base), name(every), redact(text, every) if every else text))
            yield table(SPANS, *map(list, zip(*rows)))

    return two_columns(docs, id_col, text_col).mapInArrow(run, SPANS_SQL)


def redacted(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs``, all columns, with every secret in the text as ``[secret]`` and the length column, if any, made to match."""
    ship(docs.sparkSession)

    def run(batches):
        for batch, _, _ in pieces(batches, text_col):
            texts = batch.column(text_col).to_pylist()
            new = [redact(t, every) if (every := find(t)[1]) else t for t in texts]
            names, cols = batch.schema.names, list(batch.columns)
            if new != texts:
                cols[names.index(text_col)] = pa.array(new, batch.schema.field(text_col).type)
                if length_col in names:
                    k = names.index(length_col)
                    sizes = [n if a == b else len(b) for n, a, b in zip(cols[k].to_pylist(), texts, new)]
                    cols[k] = pa.array(sizes, batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text of ``documents``."""
    found = scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = [F.expr(f"cast(size(filter(base, x -> startswith(x, '{k}:'))) as long)").alias(f"n_{k}") for k in KINDS]
    return found.select(F.col("id").alias("doc_id"), *count, F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans"))
