"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.llm.common import few, sparing, texts_in_batches, within
from platen.llm.simhash import mixed, shingle_set

TOKEN = re.compile(r"\w+")
#: Lengths of the prefixes that are features beside the token itself.
PREFIXES = (3, 4, 5, 6, 7)
#: Cells (documents times tokens) that are scored at once, and that are fitted at once; tokens whose emissions a worker keeps.
CELLS, FITTED, KEPT = 1 << 19, 1 << 18, 120_000


@dataclass(frozen=True)
class Fit:
    """Bounds of the sample of labelled documents that the model is fitted on, and settings of the fit.

    max_docs and max_bytes: labelled documents, in order of a hash of their id, so many, of which those that would go beyond the bytes are passed over; evidence
    of features comes from all of them. evidence: documents times the log of the ratio. field_tokens: the chain's weights are fitted on those of them, toxic ones of each fiftieth first, that have so many tokens together.
    """

    max_docs: int = 6000
    max_bytes: int = 48 << 20
    field_tokens: int = 400_000
    rounds: int = 40
    ratio: float = 30.0
    evidence: float = 22.0


def features(token: str) -> list[str]:
    return [f"={token}", *(token[:n] for n in PREFIXES if len(token) > n)]


def odds_of(emit: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward by odds toxic : clean, one number a step and row: transition weights, emission odds, forward odds and backward odds (steps x rows).

    emit: rows of log-odds of the toxic state; move: log transitions (2 x 2); a row starts as after a clean token.
    """
    m, odds = np.exp(move - move.max()), np.exp(np.clip(emit.T, -30, 30))
    forward, back = np.empty_like(odds), np.ones_like(odds)
    now = np.zeros(odds.shape[1])
    for t in range(len(odds)):
        now = odds[t] * (m[0, 1] + m[1, 1] * now) / (m[0, 0] + m[1, 0] * now)
        forward[t] = now
    for t in range(len(odds) - 1, 0, -1):
        ahead = odds[t] * back[t]
        back[t - 1] = np.where(lengths > t, (m[1, 0] + m[1, 1] * ahead) / (m[0, 0] + m[0, 1] * ahead), 1)
    return m, odds, forward, back


def chain(emit: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic state (0 past a row's length), and the expected transitions of all rows (2 x 2), the one into the first token included."""
    m, odds, forward, back = odds_of(emit, lengths, move)
    inside = np.arange(len(odds))[:, None] < lengths
    before, ahead = np.concatenate([np.zeros((1, odds.shape[1])), forward[:-1]]), odds * back
    pairs = [np.full_like(odds, m[0, 0]), m[0, 1] * ahead, m[1, 0] * before, m[1, 1] * before * ahead]
    total = sum(pairs)
    expected = np.array([(x / total)[inside].sum() for x in pairs]).reshape(2, 2)
    ratio = forward * back
    return np.where(inside, ratio / (1 + ratio), 0).T, expected


def chain_marginals(emit: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Marginals alone."""
    _, _, forward, back = odds_of(emit, lengths, move)
    forward *= back
    return np.where(np.arange(len(forward))[:, None] < lengths, forward / (1 + forward), 0).T


@dataclass
class Model:
    """Weights of features for the toxic state, its bias, and log transitions."""

    weights: dict[str, float]
    bias: float
    move: np.ndarray

    def emission(self, token: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features(token.lower()))


def _first_of_copies(texts: list[str]) -> list[int]:
    """Places of the texts that share none of four least shingle hashes with an earlier one."""
    seen: set[tuple[int, int]] = set()
    out = []
    for i, text in enumerate(texts):
        hashes = shingle_set(text.encode("utf-8", "replace"), 5)
        keys = [(n, int(mixed(hashes, n).min())) for n in range(4)] if len(hashes) else [(4, 0)]
        if seen.isdisjoint(keys):
            out.append(i)
        seen.update(keys)
    return out


def _parts(rows: list[tuple]) -> Iterator[list[tuple]]:
    """Rows in order of their lengths, together up to 256 and within FITTED cells: what the chain holds of a part is a dozen numbers a cell."""
    part: list[tuple] = []
    for row in rows:
        if part and (len(part) == 256 or (len(part) + 1) * row[0] > FITTED):
            yield part
            part = []
        part.append(row)
    if part:
        yield part


def fit(texts: list[str], toxic: list[int], bounds: Fit = Fit()) -> Model:  # noqa: B008
    """Fit on whole texts with document labels.

    Of copies, whole or nearly, one counts. Features that come with toxic documents by clear evidence (documents times the log of
    how much oftener than in clean ones) mark the tokens of toxic documents as toxic; all other tokens are clean. The field is fitted to these labels by gradient steps on its likelihood, with a small penalty on large weights.
    """
    once = _first_of_copies(texts)
    texts, toxic = [texts[i] for i in once], [toxic[i] for i in once]
    sizes, counts = Counter(toxic), {0: Counter(), 1: Counter()}
    for text, label in zip(texts, toxic, strict=True):
        counts[label].update({w.lower() for w in TOKEN.findall(text)})
    by = {label: Counter() for label in counts}
    for label in (1, 0):  # of clean tokens only features count that toxic ones have: all features of all tokens would be the most of the memory
        for token, n in counts[label].items():
            for f in features(token):
                if label or f in by[1]:
                    by[label][f] += n
    n1, n0, found = max(1, sizes[1]), max(1, sizes[0]), []
    for f, n in by[1].items():
        ratio = (n + 0.5) / n1 * n0 / (by[0][f] + 0.5)
        if ratio >= bounds.ratio and n * math.log(ratio) >= bounds.evidence:
            found.append((-n * math.log(ratio), f))
    del by, counts
    chosen = {f: i for i, (_, f) in enumerate(sorted(found))}
    weights, bias, move = np.zeros(len(chosen)), -4.0, np.log(np.array([[0.99, 0.01], [0.8, 0.2]]))

    rows, total, order = [], 0, sorted(range(len(texts)), key=lambda i: (i // max(1, len(texts) // 50), -toxic[i], i))
    for i in order:
        tokens = [w.lower() for w in TOKEN.findall(texts[i])]
        if tokens and total + len(tokens) <= bounds.field_tokens:
            active = [(t, chosen[f]) for t, w in enumerate(tokens) for f in features(w) if f in chosen]
            rows.append((len(tokens), active, sorted({t for t, _ in active}) if toxic[i] else []))
            total += len(tokens)
    rows.sort(key=lambda r: r[0])
    parts = []
    for part in _parts(rows):
        where = np.array([(r, t, f) for r, (_, active, _) in enumerate(part) for t, f in active], np.int64).reshape(-1, 3)
        lengths = np.array([r[0] for r in part])
        labels = np.zeros((len(part), lengths.max()), np.int8)
        for r, (_, _, marked) in enumerate(part):
            labels[r, marked] = 1
        before = np.concatenate([np.zeros((len(part), 1), np.int8), labels[:, :-1]], axis=1)
        real = np.arange(labels.shape[1]) < lengths[:, None]
        seen = np.array([[np.sum(real & (before == a) & (labels == b)) for b in (0, 1)] for a in (0, 1)], float)
        parts.append((where, lengths, labels, seen))
    firsts, squares = [np.zeros(len(weights)), 0.0, np.zeros((2, 2))], [np.zeros(len(weights)), 0.0, np.zeros((2, 2))]
    for step in range(1, bounds.rounds + 1 if parts else 1):
        gradients = [-0.05 * weights, 0.0, np.zeros((2, 2))]
        for where, lengths, labels, seen in parts:
            emit = np.full(labels.shape, bias)
            np.add.at(emit, (where[:, 0], where[:, 1]), weights[where[:, 2]])
            marginal, expected = chain(emit, lengths, move)
            gap = labels - marginal
            np.add.at(gradients[0], where[:, 2], gap[where[:, 0], where[:, 1]])
            gradients[1] += gap.sum()
            gradients[2] += seen - expected
        moves = []
        for i, g in enumerate(gradients):  # Adam
            firsts[i], squares[i] = 0.9 * firsts[i] + 0.1 * g, 0.99 * squares[i] + 0.01 * g * g
            moves.append(0.3 * firsts[i] / (1 - 0.9**step) / (np.sqrt(squares[i] / (1 - 0.99**step)) + 1e-8))
        weights, bias, move = weights + moves[0], bias + float(moves[1]), move + moves[2]
    return Model({f: float(weights[i]) for f, i in chosen.items()}, float(bias), move)


def sample(docs: DataFrame, labels: DataFrame, bounds: Fit = Fit()) -> tuple[list[str], list[int]]:  # noqa: B008
    """Whole texts and labels of labelled documents within the bounds' max_docs and max_bytes, by a hash of their id.

    Labels are learned only where crc32(doc_id as text) mod 4 isn't 2; those and texts that are null count for nothing. Of rows with one
    id, one text counts, and the id is toxic if one of its labels is.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sized = docs.where("text is not null").select("doc_id", F.struct(F.octet_length("text").alias("size"), F.xxhash64("text").alias("rid")).alias("t"))
    ids = sized.join(known, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("t").alias("t")).withColumn("place", F.xxhash64("doc_id"))
    ranked = ids.orderBy("place", "doc_id").limit(bounds.max_docs).select("doc_id", "toxic", "t.rid", "t.size").collect()
    chosen = [(ranked[i].doc_id, ranked[i].rid, ranked[i].toxic) for i in within([r.size for r in ranked], bounds.max_bytes)]
    if not chosen:
        return [], []
    named = few(docs.sparkSession, chosen, pa.schema([("id", pa.int64()), ("rid", pa.int64()), ("toxic", pa.int32())]))
    rows = docs.select("doc_id", "text").join(F.broadcast(named), (F.col("doc_id") == F.col("id")) & (F.xxhash64("text") == F.col("rid"))).select("doc_id", "text", "toxic").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: ((r.doc_id * 0x9E3779B97F4A7C15) & 0xFFFFFFFF, r.doc_id))
    return [r.text for r in rows], [int(r.toxic > 0) for r in rows]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, spans): a row for each row of docs (doc_id, text).

    Score: chance that some token is toxic, from the marginals of at least 0.1; spans: code-point offsets of runs of tokens
    that are likelier toxic than not. Null and empty texts score 0 without spans; repeated rows stay; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        kept: dict[str, float] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                texts = [t or "" for t in part.column(1).to_pylist()]
                emissions = []
                for text in texts:
                    tokens = TOKEN.findall(text)
                    for w in set(tokens).difference(kept):
                        kept[w] = m.emission(w)
                    emissions.append(np.array([kept[w] for w in tokens], np.float32))
                    if len(kept) > KEPT:
                        kept.clear()
                scores, spans = [0.0] * len(texts), [[] for _ in texts]
                for own in _packs([len(e) for e in emissions]):
                    lengths = np.array([len(emissions[i]) for i in own])
                    emit = np.zeros((len(own), lengths.max()))
                    for r, i in enumerate(own):
                        emit[r, : lengths[r]] = emissions[i]
                    marginal = chain_marginals(emit, lengths, m.move)
                    strong = np.where(marginal >= 0.1, marginal, 0)
                    total = 1 - np.exp(np.log1p(-np.minimum(strong, 1 - 1e-9)).sum(axis=1))
                    for r, i in enumerate(own):
                        scores[i] = float(min(1.0, max(0.0, total[r])))
                        if (hot := np.flatnonzero(marginal[r] >= 0.5)).size:
                            spans[i] = _spans(texts[i], hot.tolist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["doc_id", "score", "spans"])

    return texts_in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sparing(run), "doc_id long, score double, spans array<struct<start:int,end:int>>")


def _packs(sizes: list[int]) -> Iterator[list[int]]:
    """Rows of like length, together within CELLS; rows without tokens are left out."""
    pack: list[int] = []
    for i in sorted((i for i, n in enumerate(sizes) if n), key=lambda i: sizes[i]):
        if pack and (len(pack) + 1) * sizes[i] > CELLS or pack and sizes[i] > 2 * sizes[pack[0]] + 64:
            yield pack
            pack = []
        pack.append(i)
    if pack:
        yield pack


def _spans(text: str, hot: list[int]) -> list[dict[str, int]]:
    wanted, out, last = set(hot), [], -2
    for n, match in enumerate(TOKEN.finditer(text)):
        if n in wanted:
            if n == last + 1:
                out[-1]["end"] = match.end()
            else:
                out.append({"start": match.start(), "end": match.end()})
            last = n
    return out


def train(docs: DataFrame, labels: DataFrame, bounds: Fit = Fit()) -> Model:  # noqa: B008
    return fit(*sample(docs, labels, bounds), bounds)
