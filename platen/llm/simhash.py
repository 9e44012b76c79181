"""SimHash near-duplicates: fingerprints, and their links by bit-sliced comparison within exact buckets."""

from __future__ import annotations

import math
import random
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platen.llm.common import fits, small, sparing, written
from platen.llm.components import connected_components

BITS = 64
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
ONE = np.uint64(1)
#: Pairs of a row and a word of 64 rows that are compared at once, and rows that are gathered for that.
ITEMS, ROWS = 1 << 15, 1 << 14


def shingle_hashes(text: bytes | None, k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of k words (repeats included); of the whole sequence if it is shorter; none without words."""
    words = (text or b"").lower().split()  # bytes: A-Z, and the six ASCII spaces only
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(words) - k] + 1]).tolist()
    return np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts, ends[k - 1 :].tolist(), strict=True)), np.uint64, len(starts))


#: Hashes of words that a worker keeps, and odd factors by place in a shingle.
_words: dict[bytes, int] = {}
KEPT_WORDS = 300_000


def forget() -> None:
    _words.clear()


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """The sorted set of a text's shingles of k words as 64-bit hashes: of the whole sequence if it is shorter; none without words.

    A shingle's hash comes from its words' hashes by one multiplication a word, so texts aren't hashed k times over.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > KEPT_WORDS:
        _words.clear()
    for w in set(words).difference(_words):
        _words[w] = xxhash.xxh64_intdigest(w, 1)
    each = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n, size = max(1, len(words) - k + 1), min(k, len(words))
    total = np.full(n, size, np.uint64)
    for i, factor in enumerate(orders(size, 5)):
        total += each[i : i + n] * factor
    return np.unique(mixed(total, 1))


def bit_counts(words: np.ndarray) -> np.ndarray:
    """How many of the words have each bit set. In long texts carry-save adders reduce three words to a sum and a carry."""
    if len(words) < 20_000:  # bytes of 0 and 1, summed up in bytes by 255
        bits = np.unpackbits(np.ascontiguousarray(words, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        sums = np.add.reduce(bits[:whole].reshape(-1, 255, BITS), axis=1, dtype=np.uint8)
        return sums.sum(axis=0, dtype=np.int64) + np.add.reduce(bits[whole:], axis=0, dtype=np.uint8)
    return carry_save_counts(words)


def carry_save_counts(words: np.ndarray) -> np.ndarray:
    counts, weight = np.zeros(BITS, np.int64), 0
    while len(words):
        carries = []
        while len(words) >= 3:
            m = len(words) // 3
            a, b, c = words[:m], words[m : 2 * m], words[2 * m : 3 * m]
            carries.append((a & b) | (c & (a ^ b)))
            words = np.concatenate([a ^ b ^ c, words[3 * m :]])
        for w in words:
            counts += np.unpackbits(np.array([w], "<u8").view(np.uint8), bitorder="little").astype(np.int64) << weight
        words, weight = np.concatenate(carries) if carries else words[:0], weight + 1
    return counts


def orders(n: int, seed: int = 11) -> np.ndarray:
    """Odd factors: each gives the hashes another order."""
    draw = random.Random(seed)
    return np.array([draw.getrandbits(64) | 1 for _ in range(n)], np.uint64)


def mixed(hashes: np.ndarray, n: int) -> np.ndarray:
    """The n-th of several independent hashes derived from one; the hash itself for n = 0."""
    if not n:
        return hashes
    x = hashes + np.uint64(n * 0x9E3779B97F4A7C15 & int(ALL))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: bytes | None, k: int = 3, words: int = 1) -> tuple[int, ...]:
    """64 bits a word. A bit is 1 if it is set in over half of the shingle hashes; 0 for a text without words."""
    hashes = shingle_hashes(text, k)
    counts = (bit_counts(mixed(hashes, n)) for n in range(words))
    return tuple(int(np.packbits(2 * c > len(hashes), bitorder="little").view("<u8")[0]) for c in counts)


def names(words: int) -> list[str]:
    return [f"w{i}" for i in range(words)]


def fingerprints(docs: DataFrame, k: int = 3, words: int = 1) -> DataFrame:
    """(doc_id, w0, w1, ... long): a row for each row of docs; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes | None, tuple[int, ...]] = {}
            out = []
            for text in batch.column(1).to_pylist():
                if text not in seen:
                    seen[text] = fingerprint(text, k, words)
                out.append(seen[text])
            found = np.array(out, np.uint64).reshape(-1, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(found[:, i])) for i in range(words))], ["doc_id", *names(words)])

    schema = ", ".join(["doc_id long", *(f"{w} long" for w in names(words))])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(sparing(run, forget, keeps=False), schema)


@dataclass(frozen=True)
class Search:
    """Fingerprints of words * 64 bits link at radius or fewer differing bits, if they meet in a bucket.

    Each of tables is a word and a mask of the bits that must agree. Instead, each of bands may be a hash of so many rows
    least values of a text's shingles under different orders, a column k0, k1, ... beside the fingerprint. Then a byte of each of
    minima least values (a multiple of 8; those of the bands come first) lies beside, eight to a column s0, s1, ..., and of a pair so many must be agreeing.
    """

    words: int
    radius: int
    tables: tuple[tuple[int, int], ...] = ()
    bands: int = 0
    rows: int = 0
    minima: int = 0
    agreeing: int = 0

    @classmethod
    def exact(cls, radius: int = 2, parts: int = 4) -> Search:
        """64 bits. Fingerprints within the radius agree in all but radius of the parts: no link is missed."""
        edges = [BITS * i // parts for i in range(parts + 1)]
        part = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
        return cls(1, radius, tuple((0, sum(part[i] for i in kept)) for kept in combinations(range(parts), parts - radius)))

    @classmethod
    def similar(cls, jaccard: float = 0.8, words: int = 4, bands: int = 20, rows: int = 5, minima: int = 192, slack: float = 3.0) -> Search:
        """For sets of word shingles of a Jaccard similarity or more: too far apart for exact buckets of a useful size.

        A pair of similarity j meets in some band with the chance 1 - (1 - j^rows)^bands, 0.9996 at 0.8. A bit differs with the
        chance angle / pi, where cos(angle) = 2 j / (1 + j) for sets alike in size. The radius is the mean at the similarity
        plus slack standard deviations. A least value is the same with the chance j, so of minima so many agree at the similarity, less slack
        deviations. Nothing depends on the number of documents.
        """
        differ, bits = math.acos(2 * jaccard / (1 + jaccard)) / math.pi, words * BITS
        agreeing = int(minima * jaccard - slack * math.sqrt(minima * jaccard * (1 - jaccard)))
        return cls(words, int(bits * differ + slack * math.sqrt(bits * differ * (1 - differ))), (), bands, rows, minima, agreeing)

    def keys(self) -> list[Column]:
        signed = lambda m: m - (1 << 64) if m >> 63 else m
        masked = [F.col(f"w{w}").bitwiseAND(F.lit(signed(m)).cast("long")) for w, m in self.tables]
        return masked + [F.col(f"k{i}") for i in range(self.bands)]

    def columns(self) -> list[str]:
        return names(self.words) + [f"k{i}" for i in range(self.bands)] + [f"s{i}" for i in range(self.minima // 8)]


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes, stored vertically: row b holds bit b of all fingerprints, 64 to a word."""
    words = -(-len(fps) // 64)
    bits = np.zeros((words * 64, BITS), np.uint8)
    bits[: len(fps)] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def _add(counter: list[np.ndarray], bits: np.ndarray, at: int) -> None:
    for i in range(at, len(counter)):
        counter[i], bits = counter[i] ^ bits, counter[i] & bits


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose vertical counter is above the radius."""
    above, equal = np.zeros_like(counter[0]), np.full_like(counter[0], ALL)
    for i in reversed(range(len(counter))):
        if radius >> i & 1:
            equal &= counter[i]
        else:
            above |= equal & counter[i]
            equal &= ~counter[i]
    return above


def close_pairs(fps: np.ndarray, ends: np.ndarray, radius: int, same: tuple[int, int] = (0, 0), wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j < ends[i], of rows of fps (n x words) that differ in at most radius bits.

    With wanted, only pairs with such a j. The bits of same (word, mask) are known to agree up to ends[i]. A row is compared with 64 others at once: the XOR of its
    bit with a word of the bit plane goes, three planes at a time through a carry-save adder, into vertical
    counters. Blocks (a row against a word) in which every counter is past the radius are abandoned, so most
    end after a part of the planes.
    """
    planes = [planes_of(fps[:, w]) for w in range(fps.shape[1])]
    free = [(w, b) for b in range(BITS) for w in range(fps.shape[1]) if w != same[0] or not same[1] >> b & 1]
    every = 3 if radius < 8 else 24
    rows = np.arange(len(fps))
    lanes = np.full(-(-len(fps) // 64), ALL)
    if wanted is not None:
        lanes = np.packbits(np.pad(wanted, (0, -len(wanted) % 64)), bitorder="little").view("<u8")
    first, last = (rows + 1) >> 6, (ends - 1) >> 6
    sizes = np.where(ends > rows + 1, last - first + 1, 0)
    total = np.concatenate([[0], np.cumsum(sizes)])
    for at in range(0, int(total[-1]), ITEMS):
        item = np.arange(at, min(at + ITEMS, int(total[-1])))
        q = np.searchsorted(total, item, side="right") - 1
        w = first[q] + item - total[q]
        low, high = np.clip(q + 1 - 64 * w, 0, 64).astype(np.uint64), np.clip(ends[q] - 64 * w, 0, 64).astype(np.uint64)
        below = lambda n: np.where(n >= 64, ALL, (ONE << np.minimum(n, np.uint64(63))) - ONE)
        over = ~(below(high) & ~below(low) & lanes[w])
        if wanted is not None:
            some = over != ALL
            q, w, over = q[some], w[some], over[some]
        counter = [np.zeros(len(q), np.uint64) for _ in range((radius + every).bit_length())]
        for i in range(0, len(free), 3):
            diff = [planes[k][b][w] ^ (np.uint64(0) - (fps[q, k] >> np.uint64(b) & ONE)) for k, b in free[i : i + 3]]
            diff += [np.zeros(len(q), np.uint64)] * (3 - len(diff))
            a, b, c = (x & ~over for x in diff)
            _add(counter, a ^ b ^ c, 0)
            _add(counter, (a & b) | (c & (a ^ b)), 1)
            if (i + 3) % every and i + 3 < len(free):
                continue
            over |= _above(counter, radius)
            alive = over != ALL
            if (n := np.count_nonzero(alive)) < 0.8 * len(alive):
                q, w, over, counter = q[alive], w[alive], over[alive], [x[alive] for x in counter]
                if not n:
                    break
        hit = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(len(over), 8), axis=1, bitorder="little")
        which, lane = np.nonzero(hit)
        yield q[which], 64 * w[which] + lane


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of linked rows in place; label holds the smallest row of each class."""
    while True:
        la, lb = label[a], label[b]
        if not (apart := la != lb).any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(jumped := label[label], label):
            label[:] = jumped


def _groups(place: list[np.ndarray]) -> np.ndarray:
    """Number of the group of each row, by columns that the rows are sorted by."""
    new = np.zeros(len(place[0]), bool)
    for column in place:
        new[1:] |= column[1:] != column[:-1]
    return np.cumsum(new)


def _ends(group: np.ndarray) -> np.ndarray:
    """Where the group of each row ends."""
    bounds = np.concatenate([np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
    return np.repeat(bounds, np.diff(np.concatenate([[0], bounds])))


def _hits(fps: np.ndarray, ends: np.ndarray, table: np.ndarray, search: Search, same: tuple[int, int] = (0, 0), wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The close pairs of rows of fingerprints, bands and least values: by bands, a pair comes only in the first band in which it meets, and if enough least values agree."""
    keys, least = fps[:, search.words : search.words + search.bands], np.ascontiguousarray(fps[:, search.words + search.bands :]).view(np.uint8)
    for i, j in close_pairs(fps[:, : search.words], ends, search.radius, same, wanted):
        for k in range(search.bands if len(i) else 0):
            new = (table[i] <= k) | (keys[i, k] != keys[j, k])
            i, j = i[new], j[new]
        for at in range(0, len(i), 1 << 14):
            a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            enough = np.count_nonzero(least[a] == least[b], axis=1) >= search.agreeing
            yield a[enough], b[enough]


def _spanning(ids: np.ndarray, fps: np.ndarray, mark: np.ndarray, group: np.ndarray, table: np.ndarray, search: Search) -> pa.RecordBatch:
    """Rows sorted by group to links (u, v) that span the classes of each group: at most one a row."""
    ends, label = _ends(group), np.arange(len(fps))
    for t in np.unique(table):
        own = np.flatnonzero(table == t)
        part = np.arange(len(own))
        for i, j in _hits(fps[own], np.searchsorted(own, ends[own]), table[own], search, search.tables[t] if search.tables else (0, 0)):
            unite(part, i, j)
        label[own] = own[part]
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], ["u", "v"])


def _nearest(ids: np.ndarray, fps: np.ndarray, mark: np.ndarray, group: np.ndarray, table: np.ndarray, slots: int, search: Search) -> pa.RecordBatch:
    """Rows sorted by group and id to links (u, v, more): for each marked row u the nearest of the close rows before it in each of so many slots, and whether there are others."""
    ends, marked = _ends(group), np.flatnonzero(mark)
    place = np.full(len(fps), -1)
    place[marked] = np.arange(len(marked))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, (4 << 20) // slots)
    for at in range(0, len(marked), step):  # marked rows whose slots are held at once
        best, hits = np.full(min(step, len(marked) - at) * slots, ALL), np.zeros(min(step, len(marked) - at), np.int64)
        wanted = np.zeros(len(fps), bool)
        wanted[marked[at : at + step]] = True
        for i, j in _hits(fps, ends, table, search, wanted=wanted):
            hits += np.bincount(place[j] - at, minlength=len(hits))
            for part in range(0, len(i), 1 << 18):
                a, b = i[part : part + (1 << 18)], j[part : part + (1 << 18)]
                far = np.zeros(len(a), np.uint64)
                for w in range(search.words):
                    far += np.bitwise_count(fps[a, w] ^ fps[b, w])
                np.minimum.at(best, (place[b] - at) * slots + a % slots, far << np.uint64(40) | a.astype(np.uint64))
        full = best.reshape(-1, slots) != ALL
        row, slot = np.nonzero(full)
        first = (best.reshape(-1, slots)[row, slot] & np.uint64((1 << 40) - 1)).astype(np.int64)
        found.append((marked[at + row], first, hits[row] > full.sum(axis=1)[row]))
    u, v, more = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3
    return pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v]), pa.array(np.asarray(more, bool))], ["u", "v", "more"])


def buckets(fps: DataFrame, search: Search, block_rows: int, broadcast_rows: int) -> DataFrame:
    """Fingerprints (id, w0, ..., k0, ..., mark) to (id, t, key, a, b, w0, ..., k0, ..., mark), each bucket together and in order of id.

    A bucket holds the rows that agree in the bits of a table, or in a band; those of one row, or without a marked one, are left out
    before fingerprints are shuffled, if the list of the others may be broadcast. One of over block_rows rows is cut
    into blocks, and each pair of its blocks becomes a group (a, b), so no task ever holds more than two blocks and no link is lost.
    """
    columns = search.columns()
    key = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), k.alias("key")) for t, k in enumerate(search.keys())]))
    keyed = fps.select("id", *columns, "mark", key.alias("k")).select("id", *columns, "mark", "k.t", "k.key")
    sizes = fps.select("mark", key.alias("k")).select("mark", "k.t", "k.key").groupBy("t", "key").agg(F.count("*").alias("n"), F.max("mark").alias("mark")).where("n > 1 and mark")
    shared = written(sizes.select("t", "key", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")), "simhash-shared")
    if fits(shared, broadcast_rows):
        dealt = keyed.join(F.broadcast(shared), ["t", "key"])
    else:
        dealt = keyed.join(small(written(shared.where("blocks > 1"), "simhash-hot"), broadcast_rows), ["t", "key"], "left")
    own = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).otherwise(0)
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    grouped = dealt.withColumn("own", own).select("id", *columns, "mark", "t", "key", "own", other.alias("other"))
    place = ["t", "key", "a", "b"]
    ready = grouped.select("id", "t", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), *columns, "mark")
    return ready.repartition(*place).sortWithinPartitions(*place, "id")


def compared(ready: DataFrame, kernel: Callable[..., pa.RecordBatch], schema: str) -> DataFrame:
    """Buckets to what the kernel (ids, fingerprints, marks, groups, tables) gives for some whole groups at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            ids, t, key, a, b, *fp, mark = (c.combine_chunks().to_numpy(zero_copy_only=False) for c in rows.columns)
            group = _groups([t, key, a, b])
            # a group that may go on in the next batch waits for it
            cut = len(ids) if last else int(np.searchsorted(group, group[-1]))
            held[:] = rows.slice(cut).to_batches() if cut < len(ids) else []
            if cut:
                yield kernel(ids[:cut], np.stack(fp, axis=1)[:cut].view(np.uint64), mark[:cut], group[:cut], t[:cut])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS:
                yield from flush(False)
        if held:
            yield from flush(True)

    return ready.mapInArrow(sparing(run, forget, keeps=False), schema)


def links(fps: DataFrame, search: Search, block_rows: int = 8192, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Distinct fingerprints (id, w0, ..., k0, ...) to links (u, v) of ids that span all pairs which the search finds.

    Groups give links that span their classes, not all pairs.
    """
    ready = buckets(fps.withColumn("mark", F.lit(True)), search, block_rows, broadcast_rows)
    return compared(ready, lambda ids, fp, mark, group, table: _spanning(ids, fp, mark, group, table, search), "u long, v long")


def classes(prints: DataFrame, search: Search, block_rows: int = 8192) -> DataFrame:
    """(doc_id, w0, ...) to (w0, ..., component_id): the smallest doc_id that a fingerprint's links reach, its own documents included.

    The smallest id of a fingerprint comes from a partial aggregation, so copies meet once a task. A fingerprint
    of null ids alone has no links and a null component_id.
    """
    words = names(search.words)
    fps = written(prints.groupBy(*words).agg(F.min("doc_id").alias("id")), "simhash-distinct")
    roots = connected_components(links(fps.where("id is not null"), search, block_rows))
    return fps.join(roots.withColumnRenamed("u", "id"), "id", "left").select(*words, F.coalesce("root", "id").alias("component_id"))


def near_duplicates(docs: DataFrame, k: int = 3, search: Search | None = None, block_rows: int = 8192) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, component_id and the fingerprint's words w0, ....

    Documents whose fingerprints differ in at most radius bits are linked, by default at 2 of 64. Null and
    empty texts have the fingerprint 0 and are linked like any other; repeated rows stay; other columns are ignored.
    """
    search = search or Search.exact()
    prints = written(fingerprints(docs, k, search.words), "simhash")
    return prints.join(classes(prints, search, block_rows), names(search.words)).select("doc_id", "component_id", *names(search.words))


def least_values(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least value of a set of hashes under the order of each factor; the greatest number for an empty set."""
    least = np.full(len(factors), ALL)
    for at in range(0, len(hashes), 8192):
        np.minimum(least, (factors[:, None] * hashes[None, at : at + 8192]).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band, of rows least values each."""
    keys = np.zeros(bands, np.uint64)
    for column in least[: bands * rows].reshape(bands, rows).T:
        keys = mixed(keys ^ column, 1)
    return keys


def sketches(docs: DataFrame, k: int, search: Search) -> DataFrame:
    """(doc_id, rid, digest, w0, ..., k0, ..., s0, ...): rid is xxhash64(text); digest, fingerprint, bands and bytes of least values are those of the set of a text's shingle hashes, in which each shingle weighs once."""
    factors, columns = orders(max(search.bands * search.rows, search.minima)), search.columns()
    fixed = search.words + search.bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                out, digests = np.zeros((part.num_rows, len(columns)), np.uint64), []
                for r, text in enumerate(part.column(2).to_pylist()):
                    own = shingle_set(text, k)
                    digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                    out[r, : search.words] = [np.packbits(2 * bit_counts(mixed(own, n)) > len(own), bitorder="little").view("<u8")[0] for n in range(search.words)]
                    least = least_values(own, factors)
                    out[r, search.words : fixed] = band_keys(least, search.bands, search.rows)
                    out[r, fixed:] = (least[: search.minima] >> np.uint64(16)).astype(np.uint8).view("<u8")
                found = out.view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(digests, pa.binary()), *(pa.array(np.ascontiguousarray(found[:, i])) for i in range(len(columns)))], ["doc_id", "rid", "digest", *columns])

    schema = ", ".join(["doc_id long", "rid long", "digest binary", *(f"{c} long" for c in columns)])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rid"), F.col("text").cast("binary").alias("text")).mapInArrow(sparing(run, forget, keeps=False), schema)


def shingle_sets(texts: DataFrame, k: int) -> DataFrame:
    """(node, text) to (node, hashes): the sorted set of the shingle hashes; of repeated nodes one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, nodes, sets = batch.slice(at, 512), [], []
                for node, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if node not in seen:
                        seen.add(node)
                        nodes.append(node)
                        sets.append(shingle_set(text, k))
                if nodes:
                    hashes = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), hashes], ["node", "hashes"])

    return texts.select("node", F.col("text").cast("binary").alias("text")).mapInArrow(sparing(run, forget, keeps=False), "node long, hashes array<long>").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int, part_rows: int = 256, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Those pairs (u, v) whose sets (node, hashes) have a Jaccard similarity of the percent or more. A v of many pairs is dealt out in parts."""
    many = written(pairs.groupBy("v").count().where(F.col("count") > part_rows).select("v", F.ceil(F.col("count") / part_rows).alias("parts")), "simhash-many")
    many, parts = small(many, broadcast_rows), F.coalesce("parts", F.lit(1))
    dealt = pairs.join(many, "v", "left").select("u", "v", F.pmod(F.xxhash64("u"), parts).alias("part"))
    right = pairs.select("v").distinct().join(many, "v", "left").select("v", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part")).join(sets.select(F.col("node").alias("v"), F.col("hashes").alias("b")), "v")
    both = dealt.join(right, ["v", "part"]).join(sets.select(F.col("node").alias("u"), F.col("hashes").alias("a")), "u")
    total, common = F.size("a") + F.size("b"), F.size(F.array_intersect("a", "b"))
    alike = 100 * F.least(F.size("a"), F.size("b")) >= percent * F.greatest(F.size("a"), F.size("b"))
    return both.where(F.when(alike, 100 * common >= percent * (total - common)).otherwise(False)).select("u", "v")


def copies(docs: DataFrame, k: int, search: Search, percent: int = 80, block_rows: int = 8192, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(doc_id, rid) of the rows of docs (doc_id, text) to reject, rid being xxhash64(text): those whose set of shingles has an exact Jaccard
    similarity of the percent or more to that of a smaller doc_id, and of texts with equal sets all but that of the smallest id.

    The search only finds candidates. A set is compared with its nearest candidate of a smaller id; if they aren't alike and there are more, with
    the nearest in each of 32 slots, then with all. So no candidate is passed over, while a
    large group of copies costs one comparison each. Only texts that have a candidate are read again for
    that. Null ids come last; null texts are one set with those that have no words; rows equal in id and text are one text, so none of them is rejected for another.
    """
    columns = search.columns()
    prints = written(sketches(docs, k, search), "simhash-sketches")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")
    sets = prints.groupBy("digest").agg(least, F.count("*").alias("n"), *(F.min(c).alias(c) for c in columns))
    sets = sets.select("digest", "n", F.col("first.doc_id").alias("first_id"), F.col("first.rid").alias("first_rid"), *columns)
    nodes = written(sets.orderBy(F.asc_nulls_last("first_id"), "digest").withColumn("node", F.monotonically_increasing_id()), "simhash-nodes")  # grows with the id
    left, sets, gone = nodes.select(F.col("node").alias("id"), *columns, F.lit(True).alias("mark")), None, None
    for slots in (1, 32, 2 * block_rows * 64):
        ready = buckets(left, search, block_rows, broadcast_rows)
        kernel = lambda ids, fp, mark, group, table, slots=slots: _nearest(ids, fp, mark, group, table, min(slots, len(ids)), search)
        found = written(compared(ready, kernel, "u long, v long, more boolean").groupBy("u", "v").agg(F.max("more").alias("more")), "simhash-links")
        if found.isEmpty():
            break
        ends = found.select(F.col("u").alias("node")).distinct().unionByName(found.select(F.col("v").alias("node")).distinct()).distinct().join(nodes.select("node", "first_id", "first_rid"), "node")
        ends = small(written(ends, "simhash-ends"), broadcast_rows)
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ends, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.xxhash64("text") == F.col("first_rid")))
        sets = written(shingle_sets(texts, k), "simhash-compared")
        near = written(verified(found.select("u", "v"), sets, percent).select("u").distinct(), "simhash-near")
        gone = near if gone is None else gone.unionByName(near)
        open_ones = written(found.where("more").select("u").distinct().join(near, "u", "left_anti"), "simhash-open")
        if open_ones.isEmpty():
            break
        marks = small(open_ones.select(F.col("u").alias("id"), F.lit(True).alias("open")), broadcast_rows)
        left = left.drop("mark").join(marks, "id", "left").withColumn("mark", F.col("open").isNotNull()).drop("open")
    judged = nodes.select("digest", "node", "n", "first_id", "first_rid")
    copy = F.lit(False) if gone is None else F.coalesce("copy", F.lit(False))
    judged = judged if gone is None else judged.join(gone.withColumnRenamed("u", "node").withColumn("copy", F.lit(True)), "node", "left")
    judged = small(written(judged.select("digest", copy.alias("copy"), "n", "first_id", "first_rid").where("copy or n > 1"), "simhash-judged"), broadcast_rows)
    other = ~(F.col("doc_id").eqNullSafe(F.col("first_id")) & F.col("rid").eqNullSafe(F.col("first_rid")))
    return prints.select("doc_id", "rid", "digest").join(judged, "digest").where(F.col("copy") | other).select("doc_id", "rid")


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose (doc_id, xxhash64(text)) is none of gone (doc_id, rid); a null id equals a null id."""
    names_of = [f"{c}_{uuid.uuid4().hex}" for c in gone.columns]  # no columns of docs
    own = gone.toDF(*names_of)
    return docs.join(own, F.col("doc_id").cast("long").eqNullSafe(F.col(names_of[0])) & (F.xxhash64("text") == F.col(names_of[1])), "left_anti")


def without_repeats(docs: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """One of the rows that are equal in doc_id and text. Rows that don't repeat aren't moved, unless very many ids do."""
    rid = f"rid_{uuid.uuid4().hex}"  # no column of docs
    repeats = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rid")).count().where("count > 1").select("doc_id", "rid")
    repeats = written(repeats, "simhash-repeats")
    if repeats.isEmpty():
        return docs
    repeats = small(repeats, broadcast_rows)
    renamed = repeats.toDF(f"id_{rid}", rid)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(f"id_{rid}")) & (F.xxhash64("text") == F.col(rid))
    once = docs.join(renamed, same).dropDuplicates(["doc_id", rid]).select(*docs.columns)
    return without_rows(docs, repeats).unionByName(once)
