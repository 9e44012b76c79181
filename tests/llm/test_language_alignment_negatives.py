"""Language identification, alignment of two tokenizers and hard negatives against brute force and held-out rows, with nulls, empty texts, ties and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from platen.llm import alignment, language, licenses, negatives, toxicity
from platen.llm.queries import held_out, op11_language, op13_negatives, tokenizer_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
SF = "/root/testdata/sf0.001"


# --- languages ---


def test_languages_of_held_out_documents(spark):
    rows = op11_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    own = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in own) / len(own) >= 0.97
    assert all(0 <= r.score <= 1 and r.lang_pred in {"de", "en", "es", "fr", "und"} for r in rows)


def test_short_texts_and_close_languages():
    words = {"de": "und der die nicht ist", "nl": "en het een niet van", "en": "and the of not is", "fr": "et le la pas est", "it": "e il la non che"}
    rng = random.Random(2)
    known = [(" ".join(rng.choice(words[lang].split()) for _ in range(rng.randint(1, 30))), lang) for lang in words for _ in range(60)]
    machines = language.fit(*map(list, zip(*known, strict=True)))
    assert machines.families == ["germanic", "romance"] and [names for names, _ in machines.levels] == [["germanic", "romance"], ["de", "en", "nl"], ["fr", "it"]]
    told, scores = machines.predict(["nicht", "THE", "het", "non che", None, "", "123 !", "的", "nicht " * 50_000])
    assert told[:4] == ["de", "en", "nl", "it"] and told[4:7] == ["und"] * 3 and told[7] in machines.languages and told[8] == "de"
    assert scores[4:7] == [0.0] * 3


def test_language_rows(spark):
    docs = spark.createDataFrame([(1, "the and of", "en", 5), (None, "the and of", None, 5), (1, "the and of", "en", 5), (2, None, "en", 5), (3, "", None, 5), (4, "42", "fr", 5)], "doc_id long, text string, lang string, score int")
    found = sorted(map(tuple, language.predict(docs, language.train(docs, ~held_out(3, 9))).collect()), key=str)
    assert [(i, lang) for i, lang, _ in found] == [(1, "en"), (1, "en"), (2, "und"), (3, "und"), (4, "und"), (None, "en")]
    none = docs.where("false")
    assert language.predict(none, language.train(none, ~held_out(3, 9))).count() == 0
    assert {r.lang_pred for r in language.predict(docs, language.train(none, ~held_out(3, 9))).collect()} == {"und"}


def test_language_sample_passes_over_what_is_too_long(spark):
    docs = spark.createDataFrame([(i, ("a " * 5000 if i % 3 == 0 else f"text {i}"), "en" if i % 2 else "fr") for i in range(60)], "doc_id long, text string, lang string")
    texts, langs = language.sample(docs, F.lit(True), language.Fit(bytes_per_lang=1000))
    assert set(langs) == {"en", "fr"} and len(texts) >= 30 and max(map(len, texts)) < 1000
    again, _ = language.sample(docs.repartition(7), F.lit(True), language.Fit(bytes_per_lang=1000))
    assert texts == again
    assert len(language.sample(docs, F.lit(True), language.Fit(docs_per_lang=3))[0]) == 6


def test_machine_is_a_support_vector_machine():
    """Dual coordinate descent reaches the least of its squared hinge loss."""
    rng = np.random.default_rng(0)
    rows = [(np.arange(4), rng.normal(size=4) + (1 if i % 2 else -1)) for i in range(60)]
    signs = np.array([1 if i % 2 else -1 for i in range(60)])
    settings = language.Fit(penalty=1.0, rounds=300)
    w, bias = language.machine(rows, signs, settings)

    def loss(w, b):
        return (w @ w + b * b) / 2 + sum(max(0.0, 1 - s * (v @ w[:4] + b)) ** 2 for (_, v), s in zip(rows, signs, strict=True))

    least = loss(w, bias)
    for _ in range(200):
        step = np.zeros(language.BUCKETS)
        step[:4] = rng.normal(size=4) * 0.02
        assert loss(w + step, bias + rng.normal() * 0.02) >= least - 1e-6


# --- alignment ---


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(tokenizer_path(A), tokenizer_path(B))


@pytest.fixture(scope="module")
def whole(aligner):
    """Groups of a text from both libraries' tokens of the whole text."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    left, right = Tokenizer.from_file(tokenizer_path(A)), SentencePieceProcessor(model_file=tokenizer_path(B))
    left.encode_special_tokens = True

    def groups(text):
        if not text:
            return []
        a, b = left.encode(f" {text}", add_special_tokens=False).ids, right.encode(text)
        ends = []
        for ids, pieces in ((a, aligner.a.pieces), (b, aligner.b.pieces)):
            if b"".join(pieces[i] for i in ids) != f" {text}".encode():
                return []
            ends.append(np.cumsum([len(pieces[i]) for i in ids]).tolist())
        out, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            i2, j2 = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            out.append((a[i:i2], b[j:j2]))
            i, j = i2, j2
        return out

    return groups


ODD = [" ", "  ", "\n", "\r", "a", "é", "ß", ".", ";", "▁", "中", "🙂", "\t", "'s", "1", " x", "the", "<s>", "<|endoftext|>", "\xa0", "́", "\x1c", "{\r", "　", "\x00", "ſ", "�"]


def test_groups_and_links_of_odd_texts(aligner, whole):
    rng = random.Random(5)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + [None, "", " ", "  ", "a ", "x" * 5000, "ab" * 2000 + " " * 300 + "-" * 999, "\n"]
    for at in range(0, len(texts), 200):
        part = texts[at : at + 200]
        figures, digests, n, pairs, times = aligner.documents(part)
        ends = np.cumsum(n)
        for k, text in enumerate(part):
            groups = whole(text)
            said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
            links = Counter((x, y) for a, b in groups for x in a for y in b)
            own = slice(ends[k] - n[k], ends[k])
            assert figures[k].tolist() == [sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values())]
            assert digests[k] == (hashlib.sha256(said.encode()).hexdigest() if groups else "")
            assert {(int(p) >> alignment.SHIFT, int(p) & (1 << alignment.SHIFT) - 1): int(t) for p, t in zip(pairs[own], times[own], strict=True)} == dict(links)


def test_byte_level_merges_as_the_library(aligner):
    from tokenizers import Tokenizer

    left = Tokenizer.from_file(tokenizer_path(A))
    left.encode_special_tokens = True
    texts = ["".join(f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}1" for c in range(at, at + 256) if not 0xD800 <= c < 0xE000) for at in range(0, 0x20000, 1024)]
    assert aligner.a.encode(texts) == [e.ids for e in left.encode_batch(texts, add_special_tokens=False)]


def test_groups_by_bisection():
    rng = np.random.default_rng(3)
    for _ in range(200):
        size = int(rng.integers(1, 40))
        a, b = (np.append(np.sort(rng.choice(np.arange(1, size), rng.integers(0, size), replace=False)), size) for _ in range(2))
        ga, gb = alignment.groups_of(a, b)
        cuts = sorted(set(a.tolist()) & set(b.tolist()))
        assert ga.tolist() == [sum(c < e for c in cuts) for e in a.tolist()] and gb.tolist() == [sum(c < e for c in cuts) for e in b.tolist()]


def test_alignment_counts_over_the_corpus(spark, whole):
    texts = ["the cat sat on the mat", "The the  the", None, "", "naïve café ▁", "naïve café", "the cat sat on the mat", "unbelievableness ; zzzqqq"] + [f"word{i} the" for i in range(6)]
    docs = spark.createDataFrame([(i if i != 5 else None, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_a int, pairs string").repartition(3)
    grouped = [whole(t) for t in texts]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in grouped]
    count = Counter(p for own in links for p in own)
    most: dict[int, int] = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    wanted = sorted(((i if i != 5 else -1), sum(len(a) for a, _ in g), sum(own.values()), sum(t for p, t in own.items() if count[p] == most[p[0]]), sum(t * count[p] for p, t in own.items())) for i, (g, own) in enumerate(zip(grouped, links, strict=True)))
    for hot in (10**6, 5, 0):  # all pairs broadcast, some, none
        rows = alignment.align(docs, tokenizer_path(A), tokenizer_path(B), hot_pairs=hot).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_a, r.n_links, r.n_best, r.count_sum) for r in rows) == wanted
    assert alignment.align(docs.where("false"), tokenizer_path(A), tokenizer_path(B)).count() == 0


# --- negatives ---


def mined(rows, anchor, window=negatives.Window_()):  # noqa: B008
    """By brute force, in whole numbers."""
    known = {}
    for i, e, label in rows:
        if i is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            known[i] = ([math.floor(256 * x) for x in e], label)
    out = []
    for a in filter(anchor, known):
        score = {i: sum(x * y for x, y in zip(known[a][0], e, strict=True)) for i, (e, _) in known.items() if i != a}
        best = lambda own, n: sorted(own, key=lambda i: (-score[i], i))[:n]  # noqa: B023, E731
        for p in best([i for i in score if known[i][1] == known[a][1]], window.positives):
            inside = [i for i in score if known[i][1] != known[a][1] and window.lower_percent * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, n + 1, i, score[p], score[i]) for n, i in enumerate(best(inside, window.negatives))]
    return sorted(out)


ROWS = "vec_id long, embedding array<float>, label int, rank string"


@pytest.mark.parametrize("dims", [3, 8])
def test_negatives_by_brute_force(spark, dims):
    rng = np.random.default_rng(dims)
    rows = [(i, np.float32(rng.normal(size=dims) * 0.3 + 0.2).tolist(), int(rng.integers(0, 3))) for i in range(700)]
    rows += [(700 + i, rows[0][1], i % 3) for i in range(60)]  # one vector many times: ties by id
    rows += [(900, None, 1), (901, [float("nan")] * dims, 1), (902, [float("inf")] * dims, 1), (903, [None] * dims, 1), (904, rows[1][1], None), (None, rows[1][1], 1), (10_000, [0.0] * dims, 9), (10_020, [-1.0] * dims, 0)]
    wanted = mined(rows, lambda i: i % 20 == 0)
    table = spark.createDataFrame([(*r, "x") for r in rows], ROWS).repartition(5)
    found = negatives.hard_negatives(table, F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, found.collect())) == wanted and len(wanted) > 100
    assert sorted(map(tuple, negatives.hard_negatives(table.unionByName(table), F.col("vec_id") % 20 == 0).collect())) == wanted  # repeated rows count once


def test_negatives_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, np.float32(rng.normal(size=4)).tolist(), int(rng.integers(0, 2))) for i in range(300)]
    table = spark.createDataFrame([(*r, "x") for r in rows], ROWS)
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", 4 * 8 * 7)
    assert sorted(map(tuple, negatives.hard_negatives(table, F.col("vec_id") % 10 == 0).collect())) == mined(rows, lambda i: i % 10 == 0)


def test_negatives_of_nothing(spark):
    none = spark.createDataFrame([], ROWS)
    assert negatives.hard_negatives(none, F.col("vec_id") % 100 == 0).count() == 0
    alone = spark.createDataFrame([(0, [1.0, 2.0], 3, "x"), (1, [1.0, 2.0], 4, "x")], ROWS)
    assert negatives.hard_negatives(alone, F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.hard_negatives(alone, F.lit(False)).count() == 0


def test_bounds_hold_every_score():
    rng = np.random.default_rng(9)
    vectors = rng.integers(-300, 300, (500, 5))
    cuts = np.quantile(vectors, np.arange(1, negatives.CELLS) / negatives.CELLS, axis=0).T.round().astype(np.int64)
    cells = np.stack([np.searchsorted(cuts[d], vectors[:, d], "right") for d in range(5)], axis=1).astype(np.uint8)
    least, most = (np.array([[f(vectors[cells[:, d] == c, d], initial=0) if not (cells[:, d] == c).any() else f(vectors[cells[:, d] == c, d]) for c in range(negatives.CELLS)] for d in range(5)]) for f in (np.min, np.max))
    even = np.concatenate([cells, np.zeros((500, 1), np.uint8)], axis=1)
    block = negatives.Block({"ids": np.arange(500).tobytes(), "labels": np.zeros(500, np.int64).tobytes(), "vectors": vectors.tobytes(), "cells": np.ascontiguousarray((even[:, 0::2] << 4 | even[:, 1::2]).T).tobytes(), "least": least.astype(np.int64).tobytes(), "most": most.astype(np.int64).tobytes()}, 5)
    anchors = vectors[:40].astype(float)
    lower, upper = block.bounds(anchors)
    exact = anchors @ vectors.T
    assert (lower <= exact).all() and (exact <= upper).all() and (upper - lower).mean() < 0.5 * np.ptp(exact)


def test_negatives_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    rows = [(i, e, (label + 1) % 10 if i % 7 == 0 else label) for i, e, label in rows]
    assert sorted(map(tuple, op13_negatives(spark, SF).collect())) == mined(rows, lambda i: i % 100 == 0)


# --- notices within texts, and samples ---


def test_notices_within_sentences_and_wrapped_lines():
    import textwrap

    scanner, rng = licenses.Scanner(licenses.notices_by_license()), random.Random(1)
    other = "this package was made by us in our spare time please send patches to the list".split()
    for name, own in licenses.notices_by_license().items():
        for notice in own:
            wanted = scanner.known[tuple(licenses.words(notice))]
            for n in (0, 10, 60):
                around = [" ".join(rng.choice(other) for _ in range(n)) for _ in range(2)]
                found = list(scanner.scan(f"{around[0] + '. ' if n else ''}{notice} {around[1].capitalize()}"))
                assert any(r["license"] == wanted and r["confirmed"] for r in found), (name, notice, n)
            for width in (40, 72, 76, 80):
                assert any(r["license"] == wanted and r["confirmed"] and r["line"] == 2 for r in scanner.scan("Hello.\n\n" + textwrap.fill(notice, width) + "\n\nBye.")), (name, notice, width)


def test_denials_anywhere_in_the_sentence():
    scan = licenses.Scanner(licenses.notices_by_license()).scan
    for text in ("It is false that this was ever in any way released under the MIT License.", "We refuse to be licensed under the Apache License, Version 2.0.", "This is not,\nas some say,\nreleased under the MIT License."):
        assert [r["confirmed"] for r in scan(text)] == [False]
    for text in ("There is no warranty. Released under the MIT License.", "This is not free!\n\nReleased under the MIT License.", "We are not liable; released under the MIT License."):
        assert [(r["license"], r["confirmed"]) for r in scan(text)] == [("MIT", True)]


def test_notice_in_a_text_of_megabytes():
    scan = licenses.Scanner(licenses.notices_by_license()).scan
    text = "lorem ipsum dolor " * 60_000
    assert [(r["license"], r["confirmed"]) for r in scan(f"{text}released under the MIT License. {text}")] == [("MIT", True)]


def test_license_candidates_come_by_compression_alone():
    """Every notice alone is a candidate and ranked under its license; nothing is confirmed that compression doesn't tell to be one."""
    scanner = licenses.Scanner(licenses.notices_by_license())
    for notice, name in scanner.known.items():
        assert scanner.candidate(list(notice)) and name in scanner.ranked(list(notice))[1], notice
    text = "lorem ipsum. Released under the MIT License. dolor sit amet"
    assert [(r["license"], r["confirmed"]) for r in scanner.scan(text)] == [("MIT", True)]
    packers, scanner.packers = scanner.packers, {name: scanner.plain for name in scanner.packers}  # no license saves a byte
    assert not any(r["confirmed"] for r in scanner.scan(text))
    scanner.packers, scanner.any = packers, scanner.plain  # nothing is a candidate
    assert list(scanner.scan(text)) == []


def test_toxicity_sample_passes_over_what_is_too_long(spark):
    docs = spark.createDataFrame([(i, "x" * (5000 if i % 4 == 0 else 20)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    texts, _ = toxicity.sample(docs, labels, toxicity.Fit(max_bytes=1000))
    assert len(texts) > 15 and max(map(len, texts)) == 20


# --- token counts, and rows of toxicity ---


def test_token_counts_are_those_of_the_best_segmentation(spark):
    from platen.llm import unigram

    path = tokenizer_path(B)
    scores = unigram.Vocabulary.from_model(path)

    def tokens(word):
        """Best score and its count for each end of the word, over all pieces and bytes of single characters; of equal ones the longer last piece."""
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            ways = [(best[s][0] + scores.scores[word[s:end]], end - s, best[s][1] + 1) for s in range(end) if word[s:end] in scores.scores]
            if word[end - 1] not in scores.scores:
                ways.append((best[end - 1][0] + scores.unknown, 0, best[end - 1][1] + len(word[end - 1].encode())))
            top = max(ways, key=lambda w: (w[0], w[1]))
            best.append((top[0], top[2]))
        return best[-1][1]

    texts = ["the cat sat", "unbelievably  zzzqqqxx\nnaïve", "", None, "漢字 🙂 x", "the the the", "a" * 70]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    found = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in unigram.token_counts(docs, path).collect()}
    for i, t in enumerate(texts):
        words = (t or "").split()
        assert found[i] == (len(words), sum(tokens(f"▁{w}") for w in words))


def test_toxicity_rows(spark):
    texts = ["you scum and idiot", "a fine day", None, "", "scum " * 30_000]
    labels = [1, 0, 0, 0, 1]
    model = toxicity.fit([f"{t} {i}" for i, t in enumerate(["scum here", "all fine", "a day", "good scum", "an idiot", "nice"] * 20)], [1, 0, 0, 1, 1, 0] * 20, toxicity.Fit(ratio=2.0, evidence=2.0))
    docs = spark.createDataFrame([(None if i == 0 else i, t, n) for i, (t, n) in enumerate(zip(texts, labels, strict=True))] * 2, "doc_id long, text string, score int")
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 10 and sorted(r.doc_id is None for r in rows) == [False] * 8 + [True] * 2
    said: dict[object, set] = {}
    for r in rows:
        said.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(v) == 1 for v in said.values()) and said[2] == said[3] == {0.0} and min(said[4]) > 0.9 > max(said[1])


def test_toxicity_is_fitted_in_small_parts():
    """One long document doesn't make a part of 256 rows as long as itself: what the fit holds is bounded, and nothing is left out."""
    rows = [(n, [], []) for n in [5] * 600 + [9000] * 70]
    parts = list(toxicity._parts(rows))
    assert [r for p in parts for r in p] == rows and max(len(p) * p[-1][0] for p in parts) <= toxicity.FITTED and max(map(len, parts)) == 256
    assert list(toxicity._parts([(toxicity.FITTED + 1, [], [])])) == [[(toxicity.FITTED + 1, [], [])]]
