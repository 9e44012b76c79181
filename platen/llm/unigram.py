"""Token counts under a unigram vocabulary: distinct pre-tokens in trie order, forward scores once per shared prefix."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A worker keeps the counts of so many pre-tokens of at most so many bytes.
WORDS, LONG_WORD = 400_000, 64
#: What a character outside the vocabulary costs below the lowest score.
PENALTY = 10.0
START = "▁"


class Vocabulary:
    """Pieces and scores. Characters that no piece covers count as their UTF-8 bytes."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - PENALTY

    @classmethod
    def from_ranks(cls, pieces: Iterable[str]) -> Vocabulary:
        """Log-probabilities by Zipf's law from pieces in order of rank: a given vocabulary, nothing is trained."""
        pieces = list(pieces)
        total = math.log(sum(1 / r for r in range(1, len(pieces) + 1))) if pieces else 0.0
        return cls({p: -math.log(r) - total for r, p in enumerate(pieces, 1)})

    @classmethod
    def from_model(cls, path: str) -> Vocabulary:
        """The ordinary pieces of a sentencepiece model, by id."""
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        plain = (i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))
        return cls.from_ranks(sp.id_to_piece(i) for i in plain)

    def counts(self, words: Iterable[str]) -> dict[str, int]:
        """Number of tokens of each word's best segmentation.

        Sorted words are the leaves of their trie in order; scores and counts stand for the path to the current
        node, and a word goes on where its prefix parts from the last one's. Of equal scores the
        segmentation with the longer last piece holds.
        """
        get, longest = self.scores.get, self.longest
        best, count, out, last = [0.0], [0], {}, ""
        for word in sorted(words):
            shared, most = 0, min(len(last), len(word))
            while shared < most and last[shared] == word[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, n = -math.inf, 0
                for start in range(max(0, end - longest), end):
                    score = get(word[start:end])
                    if score is not None and best[start] + score > top:
                        top, n = best[start] + score, count[start] + 1
                if word[end - 1] not in self.scores and best[end - 1] + self.unknown > top:
                    top, n = best[end - 1] + self.unknown, count[end - 1] + len(word[end - 1].encode("utf-8", "replace"))
                best.append(top)
                count.append(n)
            out[word] = count[-1]
            last = word
        return out


_vocabularies: dict[str, tuple[Vocabulary, dict[bytes, int]]] = {}


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens): a row for each row of docs (doc_id, text).

    Pre-tokens are words between ASCII white space with the mark of a word start before them. A worker
    gathers the distinct new ones of a batch, scores them in trie order and keeps their counts, up to a bound, for
    all its tasks; documents add up counts, and nothing is shuffled. Null text counts as empty; bytes that aren't
    UTF-8 count as U+FFFD; repeated rows stay; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _vocabularies:
            _vocabularies[path] = (Vocabulary.from_model(path), {})
        vocabulary, known = _vocabularies[path]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [(t or b"").split() for t in part.column(1).to_pylist()]
                new = set().union(*texts).difference(known)
                if len(known) + len(new) > WORDS:
                    known.clear()
                    new = set().union(*texts)
                names = {w: START + w.decode("utf-8", "replace") for w in new}  # words that aren't UTF-8 may decode alike
                counted = vocabulary.counts(set(names.values()))
                found = {w: counted[name] for w, name in names.items()}
                totals = [sum([known[w] if w in known else found[w] for w in words]) for words in texts]
                known.update((w, n) for w, n in found.items() if len(w) <= LONG_WORD)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(totals, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
