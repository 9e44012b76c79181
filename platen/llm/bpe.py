"""BPE encoding and decoding with content-defined chunks that documents share.

A rolling hash cuts texts where their content says so, so equal passages give equal chunks wherever they stand.
A Python worker encodes each chunk once and keeps its ids, up to a size bound, for all documents of its tasks. Where two
chunks meet, the tokenizer encodes the words around the join again, on more and more words, until the ids agree with both
chunks' own at either end of the span. Nothing is shuffled: a corpus-wide table of chunks would move every
text and every id once more, over the disk allowed for that, to save the repeats between workers.

Chunks go through the tokenizer as they are. For tokenizers that encode runs of letters and of marks apart and drop white
space (found out by trial on each file), a chunk's ids are put together from kept ids of such runs, which costs less; the repair
of joins doesn't use them.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.llm.common import sparing, texts_in_batches

#: Bytes under the rolling hash; one cut in 2 to so many places; bytes that are hashed at once.
WINDOW, CUT_BITS, SLAB = 16, 11, 1 << 16
#: A worker's memory: bytes of kept chunks with their ids, kept words and parts of words, and bytes of the longest of these.
CHUNK_BYTES, KEPT, LONG_WORD = 12 << 20, 60_000, 64
#: Words on each side of a join that are encoded again at first.
SPAN_WORDS = 2

_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _roll() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(SLAB + WINDOW, base, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps, dtype=np.uint64))
    return _powers[0], _powers[1]


def cuts(text: bytes) -> list[int]:
    """Where a text is cut: after each window whose polynomial rolling hash has a chance of one in 2 to CUT_BITS, between characters."""
    up, down = _roll()
    found: list[int] = []
    for at in range(0, len(text), SLAB):
        start = max(0, at - WINDOW)
        data = np.frombuffer(text, np.uint8, min(SLAB + at - start, len(text) - start), start)
        if len(data) <= WINDOW:
            continue
        total = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)
        ends = total[WINDOW - 1 :].copy()
        ends[1:] -= total[: len(total) - WINDOW]
        mixed = ends * down[: len(ends)] * np.uint64(0xBF58476D1CE4E5B9)
        for end in (np.flatnonzero((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(64 - CUT_BITS) == 0) + WINDOW + start).tolist():
            if end > at and end < len(text) and text[end] & 0xC0 != 0x80 and (not found or found[-1] < end):
                found.append(end)
    return found


_SPACE = re.compile(rb"\s")
#: Where a word ends before white space.
_WORD_END = re.compile(rb"(?<=\S)\s")


def edges_of(text: bytes) -> list[int]:
    """Edges of the chunks. A cut goes if there would be no white space before or after it: then each chunk but a lone one has some, and a word is in two chunks at most."""
    edges = [0] if text else []
    last = 0
    for cut in [*cuts(text), len(text)] if text else []:
        if _SPACE.search(text, last, cut):
            edges.append(cut)
        last = cut
    if edges and edges[-1] != len(text):
        edges[-1:] = [len(text)] if len(edges) > 1 else [0, len(text)]
    return edges


def before(text: bytes, at: int, words: int) -> int:
    """Where the last so many words before a place start, with the white space ahead of them; 0 if there are fewer."""
    size = 32 * words
    while True:
        low = max(0, at - size)
        found = [m.start() for m in _WORD_END.finditer(text, low, at)]
        if len(found) >= words:
            return found[-words]
        if not low:
            return 0
        size *= 2


def after(text: bytes, at: int, end: int, words: int) -> int:
    """Where the first so many words after a place end; the end if there are fewer."""
    for n, m in enumerate(_WORD_END.finditer(text, at, end), 1):
        if n == words:
            return m.start()
    return end


#: Bytes of plain text: ASCII but for control characters and what contractions and special tokens start with, and Latin-1 letters.
PLAIN = bytes(b for b in range(0x20, 0x7F) if b not in b"'|") + b"\t\n\v\f\r\xc3" + bytes(range(0x80, 0xC0))
#: Runs of letters, and of digits and marks, of plain text. None goes on across the end of another, so each encodes by itself.
PARTS = re.compile(rb"[A-Za-z\x80-\xff]+|[!-&(-@\[-`{}~]+")


def is_plain(text: bytes) -> bool:
    return not text.translate(None, PLAIN) and b"\xc3\x97" not in text and b"\xc3\xb7" not in text


class Kept:
    """A memo of the latest entries: when the young ones are full they grow old, and the old ones that nobody asked for go."""

    def __init__(self) -> None:
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def get(self, key: bytes) -> bytes | None:
        ids = self.young.get(key)
        if ids is None and (ids := self.old.get(key)) is not None:
            self.put(key, ids)
        return ids

    def put(self, key: bytes, ids: bytes) -> None:
        if len(key) <= LONG_WORD:
            if len(self.young) >= KEPT:
                self.old, self.young = self.young, {}
            self.young[key] = ids


#: Texts on which it is tried whether a tokenizer encodes runs of letters and of marks apart. Fixed values.
PROBES = ("a b", "Hello, world!", "x--y  (z)\n\tw", "don't we'll", "caf\u00e9 ol\u00e9.", "<b>bold</b> & #tag $5", "tiontion inghth oneand.", "a.b.c e-mail@host.org", "\u6f22\u5b57 \u00df\u00e6", "end. Start")


class Encoder:
    """Encodes whole texts as the tokenizers library does, by way of shared chunks."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words, self.parts = Kept(), Kept()
        self.chunks: dict[bytes, bytes] = {}
        self.spans: dict[bytes, bytes] = {}
        self.held = self.reused = self.encoded = self.grown = 0
        mark = self.tokenizer.encode("\1", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else -1
        self.by_parts = all(self.of_words(x.encode()) == self._fresh([x.encode()])[0] for x in PROBES)

    def _fresh(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _each(self, parts: list[bytes]) -> list[bytes]:
        """The ids of many parts of plain words: in texts of some hundred, with a mark between them that has one id of its own."""
        out: list[bytes] = []
        for at in range(0, len(parts), 256):
            part = parts[at : at + 256]
            ids = np.array(self.tokenizer.encode_batch_fast([b" \1 ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            edges = [-1, *np.flatnonzero(ids == self.mark).tolist(), len(ids)]
            if len(edges) != len(part) + 1:
                out += self._fresh(part)
                continue
            data = ids.tobytes()
            out += [data[4 * a + 4 : 4 * b] for a, b in zip(edges, edges[1:], strict=False)]
        return out

    def learn(self, texts: list[bytes]) -> None:
        """Encode the parts that are new in some texts at once."""
        seen: set[bytes] = set()
        for text in texts:
            seen.update(PARTS.findall(text.lower()))
        new = [x for x in seen.difference(self.parts.young) if self.parts.get(x) is None]
        for x, ids in zip(new, self._each(new), strict=True):
            self.parts.put(x, ids)

    def of_parts(self, plain: bytes) -> bytes:
        parts = PARTS.findall(plain.lower())
        found = list(map(self.parts.young.get, parts))
        if None in found:
            found = [ids if ids is not None else self._kept(self.parts, x) for x, ids in zip(parts, found, strict=True)]
        return b"".join(found)

    def _kept(self, kept: Kept, text: bytes) -> bytes:
        ids = kept.get(text)
        if ids is None:
            ids = self._fresh([text])[0]
            kept.put(text, ids)
        return ids

    def of_word(self, word: bytes) -> bytes:
        return self.of_parts(word) if is_plain(word) else self._kept(self.words, word)

    def of_words(self, text: bytes) -> bytes:
        return self.of_parts(text) if is_plain(text) else b"".join([self.of_word(w) for w in text.split()])

    def of_chunk(self, chunk: bytes) -> bytes:
        ids = self.chunks.get(chunk)
        if ids is not None:
            self.reused += 1
            return ids
        self.encoded += 1
        ids = self.of_words(chunk) if self.by_parts else self._fresh([chunk])[0]
        self.held += len(chunk) + len(ids) + 150
        if self.held > CHUNK_BYTES:
            self.chunks.clear()
            self.held = len(chunk) + len(ids)
        self.chunks[chunk] = ids
        return ids

    def prepare(self, texts: list[bytes]) -> list[list[int]]:
        """The edges of some texts; what is new in them and the spans around their joins are encoded at once."""
        edges = [edges_of(t) for t in texts]
        if self.by_parts:
            self.learn(texts)
        spans: set[bytes] = set()
        for text, own in zip(texts, edges, strict=True):
            for at, end in zip(own[1:-1], own[2:], strict=True):
                low, high = before(text, at, SPAN_WORDS), after(text, at, end, SPAN_WORDS)
                spans.update((text[low:at], text[at:high], text[low:high]))
        found = sorted(spans)
        self.spans = dict(zip(found, self._fresh(found), strict=True)) if found else {}
        return edges

    def _span(self, span: bytes) -> bytes:
        ids = self.spans.get(span)
        return self._fresh([span])[0] if ids is None else ids

    def encode(self, text: bytes, edges: list[int] | None = None) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        edges = edges_of(text) if edges is None else edges
        done: list[bytes] = []
        for at, end in zip(edges, edges[1:], strict=False):
            ids = self.of_chunk(text[at:end])
            if done:
                ids = self._repaired(text, at, end, done, ids)
            done.append(ids)
        return b"".join(done)

    def _repaired(self, text: bytes, at: int, end: int, done: list[bytes], ids: bytes) -> bytes:
        """Ids that replace a chunk's after the repair of its join with what is done; ids that it takes over are cut off from those.

        A span of words on both sides is encoded again. It holds if the ids so far end in those of its left part and the chunk's ids
        start with those of its right part, and if its own ids agree with the former at its start and with the latter at its end: then
        what the join changes lies within. Otherwise the span grows; a side that reaches the end of what is known needs no agreement.
        """
        words = SPAN_WORDS
        while True:
            low, high = before(text, at, words), after(text, at, end, words)
            left, right, both = self._span(text[low:at]), self._span(text[at:high]), self._span(text[low:high])
            if len(done[-1]) < len(left):
                done[:] = [b"".join(done)]
            holds = done[-1].endswith(left) and ids.startswith(right)
            if holds and (not low or _agree(left, both)) and (high == end or _agree(right, both, ends=True)):
                done[-1] = done[-1][: len(done[-1]) - len(left)]
                return both + ids[len(right) :]
            if not low and high == end:  # the whole text so far
                done[:] = [b""]
                return both
            self.grown += 1
            words *= 2


def _agree(part: bytes, whole: bytes, *, ends: bool = False) -> bool:
    """Whether a third of the part's ids, one at least, stand at the start (or end) of the whole's."""
    n = 4 * max(1, len(part) // 12)
    return len(part) >= n and (part[-n:] == whole[-n:] if ends else part[:n] == whole[:n])


def valid(text: bytes) -> bytes:
    """The text with U+FFFD where it isn't UTF-8."""
    return text.decode("utf-8", "replace").encode()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python process; it lives as long as the worker serves no other operator, over all its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    _encoders.clear()
    _powers.clear()


def encode(docs: DataFrame, path: str, *, with_decoded: bool = False) -> DataFrame:
    """(doc_id, ids): ids is binary, little-endian unsigned 32-bit integers; a row for each row of docs (doc_id, text).

    path is a tokenizer's JSON file on every executor. With with_decoded, decode()'s column decoded is made by the same worker,
    which saves the memory of a second one. Null text counts as empty, which has no ids; bytes that aren't UTF-8 count as
    U+FFFD; repeated rows stay; other columns are ignored.
    """
    names = ["doc_id", "ids", *["decoded"] * with_decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [valid(t or b"") for t in part.column(1).to_pylist()]
                ids = [enc.encode(t, e) for t, e in zip(texts, enc.prepare(texts), strict=True)]
                columns = [part.column(0), pa.array(ids, pa.binary())]
                if with_decoded:
                    columns.append(pa.array(_decoded(enc, ids), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, ids binary" + ", decoded string" * with_decoded
    return texts_in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(sparing(run, forget), schema)


def _decoded(enc: Encoder, ids: list[bytes]) -> list[str]:
    return [enc.tokenizer.decode(np.frombuffer(x or b"", "<u4").tolist(), skip_special_tokens=False) for x in ids]


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) to (doc_id, ids, decoded), as the library decodes, special tokens included; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(_decoded(encoder(path), part.column(1).to_pylist()), pa.string())], ["doc_id", "ids", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(sparing(run, forget), "doc_id long, ids binary, decoded string")
