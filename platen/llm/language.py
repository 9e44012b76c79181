"""Language identification in two steps: the family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platen.llm.common import within

#: Families of languages by ISO 639-1 code. A language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb", "romance": "fr es pt it ro ca gl oc", "slavic": "ru uk be pl cs sk sl hr sr bs mk bg", "baltic": "lt lv",
    "uralic": "fi et hu", "turkic": "tr az kk uz ky tk", "indo-aryan": "hi bn ur mr gu pa ne", "dravidian": "ta te kn ml", "semitic": "ar he am mt",
    "celtic": "ga cy gd br", "austronesian": "id ms tl jv",
}
#: Lengths of the byte n-grams that are features, the number of features they are hashed to, and bytes that are scored at once.
GRAMS, BITS, BLOCK = (1, 2, 3, 4), 17, 1 << 18
BUCKETS = 1 << BITS
UNDETERMINED = "und"
_WORD = re.compile(r"\S+")


@dataclass(frozen=True)
class Fit:
    """Bounds of the sample that is learned from, and settings of the machines.

    docs_per_lang and bytes_per_lang: of each language documents in order of a hash of their id; one that would go beyond the bytes is passed over, and
    the next one tried. max_bytes: of all languages together; with many of them each has an equal share. windows: of each text so many runs of 1, 2, 4, .. words are learned beside the whole, so that short texts are told as well.
    """

    docs_per_lang: int = 1200
    bytes_per_lang: int = 4 << 20
    max_bytes: int = 96 << 20
    windows: int = 5
    penalty: float = 20.0
    rounds: int = 12


def family_of(lang: str) -> str:
    return next((name for name, own in FAMILIES.items() if lang.lower().split("-")[0].split("_")[0] in own.split()), f"of {lang}")


def _letters_only() -> np.ndarray:
    """Bytes as they count: capitals small; what is no letter, a blank; bytes of longer characters as they are."""
    out = np.full(256, 0x20, np.uint8)
    out[0x80:] = np.arange(0x80, 0x100)
    for c in range(ord("a"), ord("z") + 1):
        out[c] = out[c - 32] = c
    return out


_PLAIN = _letters_only()


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By length of n-grams: the hashed n-grams of all texts, one text after the other, and how many each text has.

    Runs of blanks count as one; an n-gram of blanks alone counts not.
    """
    coded = [f" {t} ".lower().encode("utf-8", "replace") for t in texts]
    plain = _PLAIN[np.frombuffer(b"".join(coded), np.uint8)]
    own = np.repeat(np.arange(len(texts), dtype=np.int32), [len(c) for c in coded])
    blank = plain == 0x20
    keep = np.ones(len(plain), bool)
    keep[1:] = ~(blank[1:] & blank[:-1]) | (own[1:] != own[:-1])
    plain, own = plain[keep].astype(np.uint32), own[keep]
    blank, mix = plain == 0x20, plain
    for n in range(1, max(GRAMS) + 1):
        if n > 1:
            mix = mix[:-1] * np.uint32(0x01000193) ^ plain[n - 1 :]
        if n in GRAMS:
            whole = ~blank if n == 1 else own[: len(mix)] == own[n - 1 :]  # two blanks never meet inside a text
            h = (mix[whole] ^ np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
            yield (h >> np.uint32(32 - BITS)).astype(np.int32), np.bincount(own[: len(mix)][whole], minlength=len(texts))


@dataclass
class Machines:
    """One-versus-one machines: weights (machines x features), half a megabyte a machine, and biases. Machine k tells names[pairs[k][0]], above 0, from names[pairs[k][1]]."""

    languages: list[str]
    families: list[str]
    #: (names, first column): the families and, for each family of several languages, its own
    levels: list[tuple[list[str], int]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, BUCKETS), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margins(self, texts: list[str]) -> np.ndarray:
        """Of each text and machine: the mean weight of the text's n-grams, with the bias."""
        out = np.tile(self.bias, (len(texts), 1))
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto]) <= BLOCK):
                size += len(texts[upto])
                upto += 1
            total, count = np.zeros((upto - at, self.weights.shape[0])), np.zeros(upto - at, np.int64)
            for found, n in grams(texts[at:upto]):
                count += n
                if len(found):
                    some, starts = n > 0, (np.cumsum(n) - n)[n > 0]
                    for k, own in enumerate(self.weights):
                        total[some, k] += np.add.reduceat(own[found], starts, dtype=np.float64)
            out[at:upto] += total / np.maximum(count, 1)[:, None]
            at = upto
        return out

    def choose(self, margins: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The name with most machines for it, ties by the sum of margins, and the mean chance that its machines give it."""
        names, first = self.levels[level]
        if len(names) == 1:
            return np.zeros(len(margins), np.int64), np.ones(len(margins))
        votes, chance = np.zeros((len(margins), len(names))), np.zeros((len(margins), len(names)))
        for k, (a, b) in enumerate(combinations(range(len(names)), 2), first):
            m = margins[:, k]
            p = 1 / (1 + np.exp(-2 * np.clip(m, -15, 15)))
            votes[:, a] += m >= 0
            votes[:, b] += m < 0
            chance[:, a] += p
            chance[:, b] += 1 - p
        best = np.argmax(votes + chance / (2 * len(names)), axis=1)
        return best, chance[np.arange(len(margins)), best] / (len(names) - 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of each text and a score of 0 to 1: the chance of the family times that of the language within it."""
        told, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.languages else []
        if not known:
            return told, scores
        margins = self.margins([texts[i] for i in known])
        family, sure = self.choose(margins, 0)
        for f in range(len(self.families)):
            own = np.flatnonzero(family == f)
            lang, surer = self.choose(margins[own], f + 1)
            for i, best, score in zip(own.tolist(), lang.tolist(), (sure[own] * surer).tolist(), strict=True):
                told[known[i]], scores[known[i]] = self.levels[f + 1][0][best], min(1.0, max(0.0, score))
        return told, scores


def machine(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, settings: Fit) -> tuple[np.ndarray, float]:
    """A linear support vector machine (squared hinge loss) by dual coordinate descent; both sides weigh alike, however many rows each has."""
    weights, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    share = {s: len(rows) / (2 * max(1, np.sum(signs == s))) for s in (1, -1)}
    ridge = [1 / (2 * settings.penalty * share[s]) for s in signs.tolist()]
    norm = [float(v @ v) + 1 + r for (_, v), r in zip(rows, ridge, strict=True)]
    rng = np.random.default_rng(7)
    for _ in range(settings.rounds):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            gradient = signs[i] * (weights[at] @ v + bias) - 1 + ridge[i] * alpha[i]
            now = max(0.0, alpha[i] - gradient / norm[i])
            if (step := (now - alpha[i]) * signs[i]) != 0:
                weights[at] += step * v
                bias += step
                alpha[i] = now
                largest = max(largest, abs(gradient))
        if largest < 0.01:
            break
    return weights, bias


def fit(texts: list[str], langs: list[str], settings: Fit = Fit()) -> Machines:  # noqa: B008
    """Fit on whole texts, and on a few short runs of words of each. Texts without a letter teach nothing."""
    known = [(t, lang) for t, lang in zip(texts, langs, strict=True) if any(map(str.isalpha, t))]
    languages = sorted({lang for _, lang in known})
    families = sorted({family_of(lang) for lang in languages})
    inside = [[lang for lang in languages if family_of(lang) == f] for f in families]
    pieces, names, rng = [], [], np.random.default_rng(11)
    for text, lang in known:
        words = _WORD.findall(text)
        for n in range(settings.windows):
            first = int(rng.integers(max(1, len(words) - (1 << n) + 1)))
            pieces.append(" ".join(words[first : first + (1 << n)]))
            names.append(lang)
        pieces.append(text)
        names.append(lang)
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    held: list[str] = []
    for at in range(0, len(pieces), 256):
        parts = [np.split(found, np.cumsum(n)[:-1]) for found, n in grams(pieces[at : at + 256])]
        for own, lang in zip(map(np.concatenate, zip(*parts, strict=True)), names[at : at + 256], strict=True):
            if len(own):
                ids, times = np.unique(own, return_counts=True)
                rows.append((ids, times / len(own) * 8))  # means, drawn apart so that the bias doesn't outweigh them
                held.append(lang)
    langs_of, kin = np.array(held), np.array([family_of(x) for x in held])
    columns, biases, levels = [], [], []
    for names, of in [(families, kin), *((own, langs_of) for own in inside)]:
        levels.append((names, len(columns)))
        for a, b in combinations(names, 2):
            chosen = np.flatnonzero((of == a) | (of == b))
            w, bias = machine([rows[i] for i in chosen], np.where(of[chosen] == a, 1, -1), settings)
            columns.append(w * 8)
            biases.append(bias)
    return Machines(languages, families, levels, np.stack(columns).astype(np.float32) if columns else np.zeros((0, BUCKETS), np.float32), np.array(biases))


def sample(docs: DataFrame, learn: Column, settings: Fit = Fit()) -> tuple[list[str], list[str]]:  # noqa: B008
    """Whole texts and languages within the bounds, of the rows for which learn holds: rows with an id, a text and a language, in order of a hash of the id.

    A first count by language gives the share of hashes that holds enough of it, so that no task ranks a language of many rows.
    """
    place = F.xxhash64("doc_id", "text")
    usable = docs.where("doc_id is not null and text is not null and lang is not null").where(learn).select(place.alias("place"), "lang", F.octet_length("text").alias("size"), "text")
    n = usable.groupBy("lang").count().collect()  # a row for each language
    if not n:
        return [], []
    rate = {r.lang: min(1.0, 4.0 * settings.docs_per_lang / r["count"]) for r in n}
    near = F.lit(False)
    for lang, share in rate.items():
        near |= (F.col("lang") == lang) & (F.col("place").cast("double") <= -(2.0**63) + share * 2.0**64)
    ranked = usable.where(near).select("place", "lang", "size").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", "size")))
    rows = sorted(ranked.where(F.col("rank") <= settings.docs_per_lang).collect(), key=lambda r: (r.lang, r["rank"]))
    chosen, most = [], min(settings.bytes_per_lang, settings.max_bytes // len(rate))
    for lang in rate:
        own = [r for r in rows if r.lang == lang]
        chosen += [own[i].place for i in within([r.size for r in own], most)]
    if not chosen:
        return [], []
    named = docs.sparkSession.createDataFrame([(p,) for p in set(chosen)], "chosen long")
    found = usable.join(F.broadcast(named), F.col("place") == F.col("chosen"), "left_semi").select("place", "lang", "text").dropDuplicates(["place"]).collect()
    found.sort(key=lambda r: (r.lang, r.place))
    return [r.text for r in found], [r.lang for r in found]


def train(docs: DataFrame, learn: Column, settings: Fit = Fit()) -> Machines:  # noqa: B008
    return fit(*sample(docs, learn, settings), settings)


def predict(docs: DataFrame, machines: Machines) -> DataFrame:
    """(doc_id, lang_pred, score): a row for each row of docs (doc_id, text), by its whole text alone.

    Null, empty and letterless texts, and all texts if nothing was learned, are 'und' with score 0; null and repeated ids and repeated rows
    are rows of their own; bytes that aren't UTF-8 count as U+FFFD; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                told, scores = shared.value.predict([t.decode("utf-8", "replace") if t else None for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(told, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
