"""Tokens of two tokenizers over the same bytes: groups, links, and how many documents hold each link.

A text is cut before each blank that follows another character than white space: no token of either tokenizer crosses such a
place (checked when a tokenizer is loaded; else a text is one chunk), so a chunk's alignment is the same in every text, and is kept.
New chunks are aligned together on one axis of bytes: B's tokens are a static interval index of sorted ends, each of A's tokens is a
stabbing query by bisection, and the gaps between A's tokens that no token of B spans are the borders of groups.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.llm.common import written

#: A worker keeps the alignments of so many chunks of at most so many characters.
CHUNKS, LONG_CHUNK = 300_000, 48
#: Pairs of ids whose counts are broadcast, the most frequent ones; the rest, each in few documents, is joined by a shuffle.
HOT_PAIRS = 500_000
#: Bits of an id of B in a pair.
SHIFT = 24
#: How a byte-level tokenizer cuts a text before it merges: a fixed pattern, the one that its file asks for by "use_regex".
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?<=\S)(?= )")
_UNEVEN = re.compile(r"\s ")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where printable, else from 256 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    return letters | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class ByteLevel:
    """A byte-level BPE file of the tokenizers library, its special tokens taken as plain text.

    Where the file's merges make ids in order and its cuts are the usual ones, tiktoken runs the same merges (a fifth of the time; tests
    compare both); else the library itself.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters, model = byte_letters(), file["model"]
        self.pieces = {i: bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode() for piece, i in model["vocab"].items()}
        for token in file.get("added_tokens", []):
            self.pieces.setdefault(token["id"], token["content"].encode())
        pre = file.get("pre_tokenizer") or {}
        usual = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not file.get("normalizer") and not model.get("ignore_merges") and not model.get("dropout")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        in_order = usual and all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges)) and sorted(model["vocab"].get(c, -1) for c in letters) == [*range(256)]
        self.cuts_before_blanks = usual
        if in_order:
            import tiktoken

            ranks = {self.pieces[i]: i for i in range(256 + len(merges))}
            self.encode = lambda texts, own=tiktoken.Encoding("own", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={}): [own.encode_ordinary(t) for t in texts]
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_str(json.dumps(file))
            own.encode_special_tokens = True
            own.no_truncation()
            own.no_padding()
            self.encode = lambda texts: [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


class Pieces:
    """A sentencepiece model; it puts a blank before each text itself, so the texts given here, which begin with one, go without it."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        own = SentencePieceProcessor(model_file=path)
        ids = range(own.get_piece_size())
        self.pieces = {i: bytes([int(own.id_to_piece(i)[3:5], 16)]) if own.is_byte(i) else own.id_to_piece(i).replace("▁", " ").encode() for i in ids}
        self.cuts_before_blanks = not any(re.search("[^▁]▁", own.id_to_piece(i)) for i in ids)
        end = own.encode("a ")[-1:]  # a blank at a text's end is a token of its own; the library gives none for an empty text
        blank = end if b"".join(map(self.pieces.get, end)) == b" " else []
        self.encode = lambda texts: [ids if t != " " else blank for t, ids in zip(texts, own.encode([t[1:] for t in texts], num_threads=1), strict=True)]


def groups_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of A and of B; both sorted, without empty tokens, over the same bytes.

    For each token of A the tokens of B that overlap it are found by two bisections in B's ends; where the last of one token of A comes before
    the first of the next, no token of B spans the gap, and a group ends.
    """
    if not len(a_ends):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a_starts = np.concatenate([[0], a_ends[:-1]])
    first = np.searchsorted(b_ends, a_starts, "right")  # the first of B that ends after the token's start
    last = np.searchsorted(b_ends, a_ends, "left")  # the one that holds the token's last byte
    opens = np.concatenate([[True], last[:-1] < first[1:]])
    group = np.cumsum(opens) - 1
    starts = first[opens]
    return group, np.searchsorted(starts, np.arange(len(b_ends)), "right") - 1


def spread(counts: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n of counts, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(values, at)


@dataclass
class Aligned:
    """Chunks aligned so far: by chunk its place; by place tokens of A and of B, groups, links (-1: bytes differ), the groups as text, and distinct pairs with their links."""

    places: dict[str, int] = field(default_factory=dict)
    figures: np.ndarray = field(default_factory=lambda: np.zeros((0, 4), np.int64))
    texts: list[str] = field(default_factory=list)
    ends: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


class Aligner:
    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.size_a, self.size_b = (np.array([len(t.pieces.get(i, b"")) for i in range(max(t.pieces) + 1)], np.int64) for t in (self.a, self.b))
        assert len(self.size_b) <= 1 << SHIFT, "B has too many ids"
        self.chunked = self.a.cuts_before_blanks and self.b.cuts_before_blanks
        self.kept = Aligned()

    def chunks(self, text: str) -> list[str]:
        """Of a blank and the text, by cutting before blanks that follow no white space."""
        text = f" {text}"
        if not self.chunked:
            return [text]
        if _UNEVEN.search(text):
            return _CUT.split(text)
        return [f" {w}" for w in text[1:].split(" ")]  # each blank stands alone

    def align(self, new: list[str]) -> Aligned:
        """Align chunks; those whose joined tokens don't give their bytes have no tokens."""
        ids = [t.encode(new) for t in (self.a, self.b)]
        right = [b"".join(map(self.a.pieces.__getitem__, x)) == (whole := c.encode("utf-8", "replace")) == b"".join(map(self.b.pieces.__getitem__, y)) for c, x, y in zip(new, *ids, strict=True)]
        n_a, n_b = (np.array([len(x) if ok else 0 for x, ok in zip(own, right, strict=True)], np.int64) for own in ids)
        flat_a, flat_b = (np.array([i for x, ok in zip(own, right, strict=True) if ok for i in x], np.int64) for own in ids)
        group_a, group_b = groups_of(np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b]))
        n_groups = int(group_a[-1]) + 1 if len(group_a) else 0
        in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        chunk_of = np.repeat(np.arange(len(new)), n_a)[np.cumsum(in_a) - in_a] if n_groups else np.zeros(0, np.int64)
        links = np.bincount(chunk_of, weights=(in_a * in_b).astype(float), minlength=len(new)).astype(np.int64)
        figures = np.stack([n_a, n_b, np.bincount(chunk_of, minlength=len(new)), np.where(right, links, -1)], axis=1)
        keys, times = self.pairs(flat_a, flat_b, in_a, in_b, chunk_of)
        own, at = keys
        said = self.said(flat_a, flat_b, in_a, in_b, chunk_of, len(new))
        return Aligned(dict(zip(new, range(len(new)), strict=True)), figures, said, np.cumsum(np.bincount(own, minlength=len(new))), at, times)

    @staticmethod
    def pairs(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, chunk_of: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        """Distinct pairs of ids by chunk, and the number of their links. Within a group equal ids are counted first, so a long group makes no more rows than it has distinct pairs."""
        groups = np.arange(len(in_a))
        sides = []
        for ids, n in ((a, in_a), (b, in_b)):
            key, times = summed(np.repeat(groups, n) << SHIFT | ids, np.ones(len(ids), np.int64))
            sides.append((key >> SHIFT, key & (1 << SHIFT) - 1, times))
        (g_a, d_a, t_a), (g_b, d_b, t_b) = sides
        n_b = np.bincount(g_b, minlength=len(in_a))
        first_b = np.cumsum(n_b) - n_b
        rows = np.repeat(np.arange(len(g_a)), n_b[g_a])
        others = first_b[g_a[rows]] + spread(n_b[g_a])
        pair, times, own = d_a[rows] << SHIFT | d_b[others], t_a[rows] * t_b[others], chunk_of[g_a[rows]]
        order = np.lexsort((pair, own))
        pair, times, own = pair[order], times[order], own[order]
        at = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (own[1:] != own[:-1])])) if len(pair) else np.zeros(0, np.int64)
        return (own[at], pair[at]), np.add.reduceat(times, at) if len(at) else times

    @staticmethod
    def said(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, chunk_of: np.ndarray, n: int) -> list[str]:
        """Each chunk's groups as text."""
        out: list[list[str]] = [[] for _ in range(n)]
        at_a = at_b = 0
        a, b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        for chunk, k, m in zip(chunk_of.tolist(), in_a.tolist(), in_b.tolist(), strict=True):
            out[chunk].append(f"{','.join(a[at_a : at_a + k])}|{','.join(b[at_b : at_b + m])}")
            at_a, at_b = at_a + k, at_b + m
        return [";".join(x) for x in out]

    def keep(self, new: list[str]) -> None:
        """Align chunks and keep them."""
        found, kept = self.align(new), self.kept
        first, after = len(kept.texts), kept.ends[-1] if len(kept.ends) else 0
        kept.places.update((c, first + i) for c, i in found.places.items())
        kept.texts.extend(found.texts)
        kept.figures, kept.ends = np.concatenate([kept.figures, found.figures]), np.concatenate([kept.ends, found.ends + after])
        kept.pairs, kept.times = np.concatenate([kept.pairs, found.pairs]), np.concatenate([kept.times, found.times])

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """By document: tokens of A, of B, groups and links; the digest of its groups; how many distinct pairs it has; and of all documents the pairs and their links."""
        cut = [self.chunks(t) if t else [] for t in texts]
        if len(self.kept.texts) > CHUNKS:
            self.kept = Aligned()
        all_chunks = set().union(*cut)
        if new := [c for c in all_chunks if len(c) <= LONG_CHUNK and c not in self.kept.places]:
            self.keep(sorted(new))
        kept, parts = self.kept, [self.kept]
        places = kept.places
        if long := sorted(c for c in all_chunks if c not in places):
            parts.append(more := self.align(long))
            base = len(kept.texts)
            extra = {c: base + i for c, i in more.places.items()}
            at = np.array([p if (p := places.get(c)) is not None else extra[c] for own in cut for c in own], np.int64)
        else:
            at = np.array([places[c] for own in cut for c in own], np.int64)
        figures = np.concatenate([p.figures for p in parts])
        said = kept.texts if len(parts) == 1 else kept.texts + parts[1].texts
        sizes = np.concatenate([np.diff(p.ends, prepend=0) for p in parts])
        pairs, times = np.concatenate([p.pairs for p in parts]), np.concatenate([p.times for p in parts])
        first = np.cumsum(sizes) - sizes
        n_chunks = np.array([len(x) for x in cut], np.int64)
        doc = np.repeat(np.arange(len(texts)), n_chunks)
        bad = np.bincount(doc, weights=figures[at, 3] < 0, minlength=len(texts)) > 0
        totals = np.zeros((len(texts), 4), np.int64)
        if len(at):
            some = n_chunks > 0
            totals[some] = np.add.reduceat(figures[at], (np.cumsum(n_chunks) - n_chunks)[some])
        totals[bad] = 0
        digests, upto = [], 0
        for n, wrong in zip(n_chunks.tolist(), bad.tolist(), strict=True):
            digests.append("" if wrong or not n else hashlib.sha256(";".join([said[i] for i in at[upto : upto + n].tolist()]).encode()).hexdigest())
            upto += n
        at, doc = at[~bad[doc]], doc[~bad[doc]]
        key, often = summed(doc << 32 | at, np.ones(len(at), np.int64))  # a chunk's pairs count once for all of its places in a document
        doc, at = key >> 32, key & 0xFFFFFFFF
        rows = np.repeat(np.arange(len(at)), sizes[at])
        where = first[at[rows]] + spread(sizes[at])
        own, pair, links = doc[rows], pairs[where], times[where] * often[rows]
        order = np.argsort(pair, kind="stable")
        order = order[np.argsort(own[order], kind="stable")]
        own, pair, links = own[order], pair[order], links[order]
        start = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (own[1:] != own[:-1])])) if len(pair) else np.zeros(0, np.int64)
        return totals, digests, np.bincount(own[start], minlength=len(texts)), pair[start], np.add.reduceat(links, start) if len(start) else links


_aligners: dict[tuple[str, str], Aligner] = {}

_SCHEMA = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each row of docs (doc_id, text): figures, the digest of the groups, and the distinct linked pairs (id of A << SHIFT | id of B) with their links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _aligners.setdefault((path_a, path_b), None) or Aligner(path_a, path_b)
        _aligners[path_a, path_b] = own
        for batch in batches:
            texts = batch.column(2).to_pylist()
            at = 0
            while at < len(texts):  # as many texts as have a few megabytes together
                upto, size = at, 0
                while upto < len(texts) and (upto == at or size + len(texts[upto] or b"") <= 2 << 20):
                    size += len(texts[upto] or b"")
                    upto += 1
                figures, digests, n, pairs, times = own.documents([t.decode("utf-8", "replace") if t else None for t in texts[at:upto]])
                ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                columns = [batch.column(0).slice(at, upto - at), batch.column(1).slice(at, upto - at), *(pa.array(figures[:, k]) for k in range(4)), pa.array(digests, pa.string())]
                columns += [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (pairs, times)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
                at = upto

    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return named.mapInArrow(run, _SCHEMA)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents each pair is linked, and whether no pair of its id of A is linked in more."""
    n = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    n = written(n, "pair-counts")
    most = n.groupBy(F.shiftright("pair", SHIFT).alias("a")).agg(F.max("n").alias("most"))
    return written(n.join(most, F.shiftright("pair", SHIFT) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best")), "pair-ranks")


def hot_from(counts: DataFrame, rows: int) -> int:
    """The least power of two such that at most so many pairs are linked in as many documents or more."""
    steps = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect()  # a row for each power of two
    total, least = 0, 62
    for k, n in sorted(((r.k, r["count"]) for r in steps), reverse=True):
        total += n
        if total > rows:
            break
        least = k
    return 1 << least


def align(docs: DataFrame, path_a: str, path_b: str, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): a row for each row of docs (doc_id, text).

    n_best: links of pairs that are linked in as many documents as any pair of their id of A; count_sum: over links, the documents that hold the pair.
    Null and empty texts, and those whose tokens of either side don't give back a blank and the text, have zeros and an empty digest; null and
    repeated ids and repeated rows are rows of their own; bytes that aren't UTF-8 count as U+FFFD; other columns are ignored.
    """
    found = written(aligned(docs, path_a, path_b), "aligned", compression="zstd")
    counts = pair_counts(found)
    least = hot_from(counts, hot_pairs)
    rows = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    hot = F.broadcast(counts.where(F.col("n") >= least))
    sums = (F.sum(F.col("best") * F.col("times")).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    own = rows.join(hot, "pair").groupBy("row").agg(*sums)
    if least > 1:  # pairs of few documents each: no key is hot
        rest = rows.join(hot, "pair", "left_anti").join(counts.where(F.col("n") < least), "pair").groupBy("row").agg(*sums)
        own = own.unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    figures = found.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = F.lit(0).cast("long")
    return figures.join(own, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
