"""Hard negatives by a vector-approximation file.

Each dimension is cut into cells by quantiles of a bounded sample; a row is kept as its cells beside its whole vector, rows of the file in blocks.
For an anchor the least and the greatest contribution of each cell are tables, and a block's bounds of scores are sums of looked-up entries. Only
rows that may be among the first positives, or may fall into a window of negatives, are scored exactly; bounds never lose a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platen.llm.common import written

#: Cells a dimension (a code has four bits, two make a byte), rows a block of the file, bytes of anchors that go round together, and bounds that are held at once.
CELLS, ROWS, ANCHOR_BYTES, HELD = 16, 4096, 16 << 20, 1 << 21
#: Vectors that the cells' borders are fitted on, by a hash of id and vector: some few more or less, for the hash decides.
SAMPLE = 8192


@dataclass(frozen=True)
class Window_:
    """positives and negatives: how many of each; a negative's score is between lower_percent of the positive's and the positive's."""

    positives: int = 5
    negatives: int = 5
    lower_percent: int = 80


def usable(rows: DataFrame, vec_id: Column, embedding: Column, label: Column) -> DataFrame:
    """(vec_id, label, v): rows that take part, components as floor(256 * x)."""
    given = rows.select(vec_id.cast("long").alias("vec_id"), label.alias("label"), embedding.cast("array<double>").alias("e")).where("vec_id is not null and label is not null and e is not null")
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return given.where(finite).select("vec_id", F.col("label").cast("long").alias("label"), F.transform("e", lambda x: F.floor(x * 256).cast("long")).alias("v"))


def borders(rows: DataFrame, dims: int) -> np.ndarray:
    """dims x CELLS + 1 borders of cells (least and greatest value within), from quantiles of a sample."""
    n = rows.count()
    share = min(1.0, SAMPLE / max(1, n))
    near = F.xxhash64("vec_id", "v").cast("double") <= -(2.0**63) + share * 2.0**64
    taken = rows.where(near).select("v").limit(2 * SAMPLE).toArrow().column("v")
    values = np.array(taken.to_pylist(), np.float64).reshape(-1, dims)
    if not len(values):
        return np.zeros((dims, CELLS - 1), np.int64)
    return np.quantile(values, np.arange(1, CELLS) / CELLS, axis=0).T.round().astype(np.int64)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


_FILE = "part int, n int, ids binary, labels binary, vectors binary, cells binary, least binary, most binary"


def file_of(rows: DataFrame, cuts: np.ndarray) -> DataFrame:
    """The file: a row for each block of ROWS rows or fewer: ids, labels, vectors, codes (two dimensions a byte), and for the block the range of values of each cell."""
    dims = len(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            ids, labels = (np.concatenate([p.column(k).to_numpy() for p in parts]) for k in (0, 1))
            vectors = np.concatenate([_matrix(p.column(2), dims) for p in parts])
            cells = np.stack([np.searchsorted(cuts[d], vectors[:, d], "right") for d in range(dims)], axis=1).astype(np.uint8)
            least, most = np.full((dims, CELLS), np.iinfo(np.int64).max), np.full((dims, CELLS), np.iinfo(np.int64).min)
            for d in range(dims):
                np.minimum.at(least[d], cells[:, d], vectors[:, d])
                np.maximum.at(most[d], cells[:, d], vectors[:, d])
            least[least > most] = 0
            most[most < least] = 0
            even = cells if dims % 2 == 0 else np.concatenate([cells, np.zeros((len(cells), 1), np.uint8)], axis=1)
            codes = np.ascontiguousarray((even[:, 0::2] << 4 | even[:, 1::2]).T)
            return pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([len(ids)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, labels, vectors, codes, least, most))], [c.split()[0] for c in _FILE.split(", ")])

        waiting = 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                held.append(part := batch.slice(at, ROWS))
                waiting += part.num_rows
                if waiting >= ROWS:
                    yield block(held)
                    held, waiting = [], 0
        if held:
            yield block(held)

    return rows.select("vec_id", "label", "v").mapInArrow(run, _FILE)


class Block:
    """A block of the file, and bounds of its scores for anchors."""

    def __init__(self, row: dict, dims: int) -> None:
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.int64).reshape(-1, dims).astype(np.float64)
        self.codes = np.frombuffer(row["cells"], np.uint8).reshape(-1, len(self.ids))
        self.least, self.most = (np.frombuffer(row[k], np.int64).reshape(dims, CELLS).astype(np.float64) for k in ("least", "most"))

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of each anchor with each row, from tables of two dimensions' cells."""
        lower, upper = (np.zeros((len(anchors), len(self.ids))) for _ in range(2))
        ends = np.stack([anchors[:, :, None] * self.least, anchors[:, :, None] * self.most])
        low, high = ends.min(axis=0), ends.max(axis=0)
        if low.shape[1] % 2:
            low, high = (np.concatenate([x, np.zeros((len(x), 1, CELLS))], axis=1) for x in (low, high))
        for pair, codes in enumerate(self.codes):
            for table, total in ((low, lower), (high, upper)):
                both = (table[:, 2 * pair, :, None] + table[:, 2 * pair + 1, None, :]).reshape(len(anchors), CELLS * CELLS)
                total += np.take(both, codes, axis=1)
        return lower, upper

    def exact(self, anchors: np.ndarray, a: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", anchors[a], self.vectors[rows])


@dataclass
class Anchors:
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray


def first_of(keys: np.ndarray, scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first rows of each key: greater scores first, ties by smaller id."""
    order = np.lexsort((ids, -scores, keys))
    k = keys[order]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    rank = np.arange(len(k)) - np.repeat(start, np.diff(np.append(start, len(k))))
    return order[rank < most]


@dataclass
class First:
    """The first rows of each key among all that a task has seen, as arrays of keys, ids and scores."""

    most: int
    keys: np.ndarray
    ids: np.ndarray
    scores: np.ndarray

    @classmethod
    def none(cls, most: int) -> First:
        return cls(most, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def add(self, keys: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        keys, ids, scores = (np.concatenate(x) for x in ((self.keys, keys), (self.ids, ids), (self.scores, scores)))
        best = first_of(keys, scores, ids, self.most)
        self.keys, self.ids, self.scores = keys[best], ids[best], scores[best]

    def worst(self, n: int) -> np.ndarray:
        """By key the score of the last of its rows, if it has all; else -inf."""
        out, count = np.full(n, np.inf), np.bincount(self.keys, minlength=n)
        np.minimum.at(out, self.keys, self.scores)
        return np.where(count >= self.most, out, -np.inf)


def positives_in(block: Block, anchors: Anchors, most: int, reached: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors (places), rows and scores that are among the block's first positives and not below what the anchor has reached."""
    out = []
    for label in np.unique(anchors.labels):
        rows, own = np.flatnonzero(block.labels == label), np.flatnonzero(anchors.labels == label)
        if not len(rows):
            continue
        same = Block.__new__(Block)
        same.ids, same.labels, same.vectors, same.codes, same.least, same.most = block.ids[rows], block.labels[rows], block.vectors[rows], block.codes[:, rows], block.least, block.most
        step = max(1, HELD // len(rows))
        for at in range(0, len(own), step):
            some = own[at : at + step]
            lower, upper = same.bounds(anchors.vectors[some])
            itself = same.ids == anchors.ids[some][:, None]
            lower[itself] = -np.inf
            kth = np.partition(lower, max(0, len(rows) - most), axis=1)[:, max(0, len(rows) - most)] if len(rows) > most else np.full(len(some), -np.inf)
            a, r = np.nonzero((upper >= np.maximum(kth, reached[some])[:, None]) & ~itself)
            scores = same.exact(anchors.vectors[some], a, r)
            best = first_of(a, scores, same.ids[r], most)
            out.append((some[a[best]], rows[r[best]], scores[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def negatives_in(block: Block, anchors: Anchors, asked: np.ndarray, scores: np.ndarray, window: Window_) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each question (an anchor's place and a positive's score): rows and scores that are among the block's first in its window."""
    out = []
    floor = np.ceil(window.lower_percent * scores / 100)  # integers well below 2^53
    used, place = np.unique(asked, return_inverse=True)
    widest_low, widest_high = np.full(len(used), np.inf), np.full(len(used), -np.inf)
    np.minimum.at(widest_low, place, floor)
    np.maximum.at(widest_high, place, scores)
    by_anchor = np.argsort(place, kind="stable")
    ends = np.cumsum(np.bincount(place, minlength=len(used)))
    step = max(1, HELD // max(1, len(block.ids)))
    for at in range(0, len(used), step):
        some = used[at : at + step]
        lower, upper = block.bounds(anchors.vectors[some])
        possible = (upper >= widest_low[at : at + step, None]) & (lower <= widest_high[at : at + step, None]) & (block.labels != anchors.labels[some][:, None])
        a, r = np.nonzero(possible)
        exact = block.exact(anchors.vectors[some], a, r)
        sizes = np.diff(ends, prepend=0)[at : at + step]
        n = sizes[a]  # each question of the anchor
        rows = np.repeat(np.arange(len(a)), n)
        first = np.cumsum(n) - n
        question = by_anchor[(ends - np.diff(ends, prepend=0))[at + a[rows]] + np.arange(len(rows)) - np.repeat(first, n)] if len(rows) else np.zeros(0, np.int64)
        inside = (exact[rows] >= floor[question]) & (exact[rows] <= scores[question])
        rows, question = rows[inside], question[inside]
        best = first_of(question, exact[rows], block.ids[r[rows]], window.negatives)
        out.append((question[best], r[rows[best]], exact[rows[best]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[Block]:
    for batch in batches:
        for row in batch.to_pylist():
            yield Block(row, dims)


def hard_negatives(rows: DataFrame, is_anchor: Column, window: Window_ = Window_(), label: Column | None = None) -> DataFrame:  # noqa: B008
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, embedding, label).

    Scores are integer inner products of floor(256 * x); greater ones come first, ties by smaller vec_id. An anchor's positives are its first
    other rows of its label; its negatives for each are the first rows of other labels in the window. Rows with a null id, label or vector, with a
    null or non-finite component, or of another length than most rows, take no part; of rows with one id, label and vector one counts;
    rows with one id and unlike vectors are rows of their own, but an anchor's own id is never its positive. Other columns are ignored.

    Scores are exact below 2^53, so for components of up to 2^20 in 64 dimensions.

    Anchors are dealt out by a hash of their id to as many rounds as keep them within ANCHOR_BYTES, and each round goes through the whole file; what the driver
    hands out is that round's anchors and their positives.
    """
    own = usable(rows, F.col("vec_id"), F.col("embedding"), F.col("label") if label is None else label)
    own = written(own.distinct(), "vectors")
    lengths = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not lengths or not lengths[0].n:
        return rows.sparkSession.createDataFrame([], schema)
    dims = lengths[0].n
    own = own.where(F.size("v") == dims)
    file = written(file_of(own, borders(own, dims)), "vector-file", compression="zstd")
    queries = own.where(is_anchor)
    rounds = -(-queries.count() * dims * 8 // ANCHOR_BYTES)
    found: DataFrame | None = None
    for k in range(rounds):
        part = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == k).toArrow()
        anchors = Anchors(part.column("vec_id").to_numpy(), part.column("label").to_numpy(), _matrix(part.column("v").combine_chunks(), dims).astype(np.float64))
        mined = _round(file, anchors, dims, window)
        found = mined if found is None else found.unionByName(mined)
    return found if found is not None else rows.sparkSession.createDataFrame([], schema)


def _round(file: DataFrame, anchors: Anchors, dims: int, window: Window_) -> DataFrame:
    context = file.sparkSession.sparkContext
    shared = context.broadcast(anchors)

    def positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, own = First.none(window.positives), shared.value
        for block in _blocks(batches, dims):
            a, r, scores = positives_in(block, own, window.positives, best.worst(len(own.ids)))
            best.add(a, block.ids[r], scores)
        yield pa.RecordBatch.from_arrays([pa.array(best.keys), pa.array(best.ids), pa.array(best.scores.astype(np.int64))], ["anchor", "positive_id", "positive_score"])

    first = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")  # a few rows of each task
    ranked = file.mapInArrow(positives, "anchor long, positive_id long, positive_score long").withColumn("place", F.row_number().over(first))
    kept = written(ranked.where(F.col("place") <= window.positives), "positives").toArrow()
    asked, scores, ids = kept.column("anchor").to_numpy(), kept.column("positive_score").to_numpy().astype(np.float64), kept.column("positive_id").to_numpy()
    questions = context.broadcast((asked, scores, ids))

    def negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (asked, scores, ids), best = questions.value, First.none(window.negatives)
        for block in _blocks(batches, dims):
            q, r, found = negatives_in(block, shared.value, asked, scores, window)
            best.add(q, block.ids[r], found)
        q = best.keys
        columns = [q, shared.value.ids[asked[q]], ids[q], scores[q].astype(np.int64), best.ids, best.scores.astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["question", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    first = Window.partitionBy("question").orderBy(F.desc("negative_score"), "negative_id")
    made = file.mapInArrow(negatives, "question long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    return made.withColumn("rank", F.row_number().over(first).cast("int")).where(F.col("rank") <= window.negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
