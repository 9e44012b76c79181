"""Each operator against brute force, an exact round trip or a hand-made case, with nulls, empty texts, ties and clashing columns."""

import base64
import gzip
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from platen.llm import bpe, chat, decontaminate, licenses, quality, simhash, toxicity, unigram, urls, warc
from platen.llm.queries import TOXIC, URL_RULES, tokenizer_path

DOCS = "doc_id long, text string, source string, fp string, n_words int"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "s", "x", 7) for i, t in enumerate(texts)], DOCS)


def test_warc_round_trip(spark):
    big = "".join(random.Random(1).choice("abc\r\n") for _ in range(200_000)) + "\r\n\r\nWARC/1.1\r\n\r\n"
    pages = [(1, "http://a/", "x"), (2, None, None), (3, "http://b/\r\n", big), (4, "u", "x"), (5, "u", big), (6, "u", ""), (None, "u", "n")]
    found = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(found) == 7 and found[3].segments > 1 and found[3].complete
    for i, _, html in pages:
        data = (html or "").encode()
        assert found[i].payload_bytes == len(data) and found[i].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert {i: r.refers_to for i, r in found.items() if r.record_type == "revisit"} == {4: 1, 5: 3, 6: 2}
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_has_a_record_for_each_row(spark):
    pages = [(None, "a", "x"), (None, "a", "x"), (7, "y", "z"), (8, "u", "same"), (8, "v", "same"), (8, "v", "same"), (9, "w", "same")]
    rows = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in rows) == [(0, "response", 0)] * 2 + [(7, "response", 0)] + [(8, "response", 0)] * 3 + [(9, "revisit", 8)]


def test_warc_keeps_cut_off_records_as_incomplete(spark, tmp_path):
    pages = [(i, "u", f"page {i} " + "x" * 300) for i in range(20)]
    warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), str(tmp_path / "a"))
    (file,) = (tmp_path / "a").glob("*.gz")
    (tmp_path / "b").mkdir()
    with gzip.open(tmp_path / "b" / "cut.gz", "wb") as out:
        out.write(gzip.open(file).read()[:-200])
    rows = warc.read_warc(spark, str(tmp_path / "b")).collect()
    assert len(rows) == 20 and sorted(r.page_id for r in rows if not r.complete) == [19] and all(r.payload for r in rows if r.complete)


def test_dechunking_rejects_broken_framing():
    data = bytes(range(256)) * 9
    assert warc.dechunked(warc.chunked(data, 100)) == data
    assert warc.dechunked(warc.chunked(data, 100)[:-30]) is None and warc.dechunked(b"zz\r\n") is None


def plain_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text)) if w]
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("n", [0, 1, 2, 254, 255, 256, 700, 25_000])
def test_bit_counts(n):
    words = np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64)
    plain = [int((words >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)]
    assert simhash.bit_counts(words).tolist() == simhash.carry_save_counts(words).tolist() == plain


def test_similar_texts_are_those_of_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null")
    sets = {r.doc_id: frozenset(zip(*(r.text.lower().split()[i:] for i in range(5)))) or frozenset([tuple(r.text.lower().split())]) for r in docs.collect()}
    expected, by_shingle = set(), {}
    for i in sorted(sets):
        near = {j for x in sets[i] for j in by_shingle.get(x, ())}
        if any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in near):
            expected.add(i)
        for x in sets[i]:
            by_shingle.setdefault(x, []).append(i)
    found = {r.doc_id for r in simhash.copies(docs, 5, simhash.Search.similar()).collect()}
    assert found <= expected and len(found) >= 0.99 * len(expected) > 10


def test_candidates_beyond_the_nearest_are_compared(spark):
    rng = np.random.default_rng(1)
    words = ["".join(map(chr, rng.integers(97, 123, 7))) for _ in range(400)]
    base = words[:60]
    texts = [" ".join(base[: 60 - i] + words[100 + 5 * i : 100 + 6 * i]) for i in range(2, 14)] + [" ".join(base)]  # ever fewer words in common
    found = {r.doc_id for r in simhash.copies(docs_of(spark, texts * 3), 5, simhash.Search.similar(), block_rows=4).collect()}
    sets = [frozenset(zip(*(t.split()[i:] for i in range(5)))) for t in texts * 3]
    assert found == {b for b in range(len(sets)) if any(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a in range(b))}


def test_close_pairs_are_those_of_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 20, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << np.uint64(rng.integers(64))) ^ (np.uint64(rng.integers(2)) << np.uint64(rng.integers(64))) for _ in range(12))]))
    got = {(int(a), int(b)) for i, j in simhash.close_pairs(fps[:, None], np.full(len(fps), len(fps)), 2) for a, b in zip(i, j)}
    assert got == {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if int(fps[a] ^ fps[b]).bit_count() <= 2}


def test_near_duplicates_with_blocks_of_hot_buckets(spark):
    texts = [None, "", "  \n", "one two", "One TWO", *(f"a b c d e f g h {i % 3}" for i in range(60))]
    found = {r.doc_id: r for r in simhash.near_duplicates(docs_of(spark, texts), block_rows=4).collect()}
    prints = {i: plain_fingerprint(t or "") for i, t in enumerate(texts)}
    assert {i: r.w0 % 2**64 for i, r in found.items()} == prints
    root = {i: i for i in prints}
    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert {i: r.component_id for i, r in found.items()} == root


def test_bpe_is_the_librarys(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CUT_BITS", 5)
    enc, rng = bpe.Encoder(tokenizer_path("word_bpe_49k.json")), random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["a", "B", "é", "é", " ", "\n", "'s", ".", "!!", "<|endoftext|>", "7", "漢", "\x1c", "|"]) for _ in range(rng.randint(0, 600)))
        assert enc.encode(text.encode()) == np.array(enc.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    rows = bpe.encode(docs_of(spark, [None, "", "a b"]), tokenizer_path("word_bpe_49k.json"), with_decoded=True).collect()
    assert [len(r.ids) // 4 for r in rows] == [0, 0, 2] and rows[0].decoded == ""


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_joins_are_repaired(monkeypatch, name):
    monkeypatch.setattr(bpe, "CUT_BITS", 3)
    monkeypatch.setattr(bpe, "SPAN_WORDS", 1)
    enc, rng = bpe.Encoder(tokenizer_path(name)), random.Random(4)
    assert enc.by_parts == name.startswith("word")
    differ = 0
    for _ in range(150):
        text = "".join(rng.choice(["tion", "ing", "e", "\u0301", " ", "  ", "\n", "'s", ".", "the", "<|endoftext|>", "7", "\u00a0"]) for _ in range(rng.randint(0, 400)))
        data = text.encode()
        expected = np.array(enc.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert enc.encode(data, enc.prepare([data])[0]) == expected == enc.encode(data)
        edges = bpe.edges_of(data)
        differ += b"".join(enc.of_chunk(data[a:b]) for a, b in zip(edges, edges[1:])) != expected
    assert differ > 20 and enc.grown > 0  # unrepaired chunks are wrong, and some joins fail at first


def test_bpe_of_malformed_text_and_of_one_long_word(spark):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text UNION ALL SELECT NULL, 'ab' UNION ALL SELECT 2L, repeat('ab', 300000)")
    rows = {r.doc_id: r for r in bpe.encode(docs, tokenizer_path("word_bpe_49k.json"), with_decoded=True).collect()}
    tokenizer = bpe.Encoder(tokenizer_path("word_bpe_49k.json")).tokenizer
    for i, text in [(1, "a\ufffdb"), (None, "ab"), (2, "ab" * 300000)]:
        assert rows[i].ids == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    counts = {r.doc_id: r.n_pretokens for r in unigram.token_counts(docs, tokenizer_path("piece_bpe_32k.model")).collect()}
    assert counts == {1: 1, None: 1, 2: 1}


def test_decontamination_of_short_items_and_nulls(spark):
    items = spark.createDataFrame([(1, "Alpha beta"), (2, "gamma"), (3, None), (4, " ".join(f"w{i}" for i in range(12)))], "item_id long, text string")
    texts = [None, "", "x ALPHA, beta y", "gamma gamma", " ".join(f"w{i}" for i in range(1, 11)), " ".join(f"w{i}" for i in range(9)), "alpha"]
    found = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(docs_of(spark, texts), items).collect()}
    assert found == {0: (0, 0, []), 1: (0, 0, []), 2: (4, 2, ["1"]), 3: (2, 2, ["2"]), 4: (10, 10, ["4"]), 5: (9, 0, []), 6: (1, 0, [])}


def test_chat_reads_back_and_masks(spark):
    rows = [(1, 0, "user", "</s>[INST] ok \\ <|im_end|>"), (1, 1, "user", None), (1, 2, "assistant", "<|im_next|>é\n"), (1, 3, "assistant", "b\\|"), (2, 0, None, "x")]
    read = {r.conv_id: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert [(t.role, t.text) for t in read[1].turns] == [(r, t or "") for _, _, r, t in rows[:4]] and read[1].learned == ["<|im_next|>é\n", "b\\|"]
    assert [(t.role, t.text) for t in read[2].turns] == [("", "x")] and "</s>" not in read[1].formatted


def test_chat_of_a_long_conversation_with_ties(spark, monkeypatch):
    monkeypatch.setattr(chat, "LONG", 50)
    turns = [(1, i // 2, ["user", "assistant"][i % 3 > 0], f"t\u00e9xt {i} [INST]") for i in range(3000)] * 2
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    (r,) = chat.read_back(chat.format_conversations(df)).collect()
    order = sorted(turns, key=lambda t: (t[1], t[2], t[3]))
    assert [(t.role, t.text) for t in r.turns] == [t[2:] for t in order] and r.learned == [t[3] for t in order if t[2] == "assistant"]
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_empty_tables(spark):
    nothing = docs_of(spark, [])
    assert unigram.token_counts(nothing, tokenizer_path("piece_bpe_32k.model")).count() == 0
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string")).count() == 0
    assert toxicity.sample(nothing, spark.createDataFrame([], "doc_id long, toxic int")) == ([], [])
    assert simhash.copies(nothing, 5, simhash.Search.similar()).count() == bpe.encode(nothing, tokenizer_path("word_bpe_49k.json")).count() == 0


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "some words here")] * 2 + [(4, None)] * 2, "doc_id long, text string")
    assert [(r.doc_id, r.n_pretokens) for r in unigram.token_counts(docs, tokenizer_path("piece_bpe_32k.model")).collect()] == [(None, 3)] * 2 + [(4, 0)] * 2
    pages = spark.createDataFrame([(None, "http://example.org/es/")] * 2, "page_id long, url string")
    assert [r.verdict for r in urls.judge(pages, spark.createDataFrame(URL_RULES, "host string, path string, verdict string")).collect()] == ["block"] * 2


def test_quality_removes_frequent_lines_and_keeps_copies(spark):
    own = lambda i: " ".join("q" + "".join(chr(97 + int(c)) for c in f"{i}{j:02d}") for j in range(30))
    texts = [f"Common line {i}\n{own(i)}\nend {own(1000 + i)} z" for i in range(40)] + [f"{own(99)}\nsame {own(98)}\nlast"] * 40
    found = {r.doc_id: r for r in quality.judge(docs_of(spark, texts)).collect()}
    assert all(r.kept for r in found.values()) and all(found[i].n_removed_words == 3 for i in range(40)) and found[50].n_removed_words == 0
    base = {r.doc_id: r for r in quality.judge(docs_of(spark, [None, "", "a b c d e f g h " * 3])).collect()}
    assert not base[0].kept and base[2].n_repeat_words == 24 and base[2].base_failed


def test_quality_counts_documents_made_of_shared_lines(spark):
    shared = [f"{w} navigation entry of every page here" for w in ("home", "about", "contact", "search", "legal", "imprint")]
    letters = lambda i: chr(97 + i // 26) + chr(97 + i % 26)
    mixed = [[x for j, x in enumerate(shared) if i >> j & 1] for i in range(1, 64)]  # no line of their own, each a different text
    texts = ["\n".join([*shared, f"own {letters(i)}"]) for i in range(40)] + ["\n".join(x) for x in mixed] + [shared[0]] * 5
    found = {r.doc_id: r for r in quality.judge(docs_of(spark, texts)).collect()}
    assert all(found[i].n_removed_words == 42 and not found[i].base_failed and not found[i].kept for i in range(40))
    assert all(found[40 + i].n_removed_words == 7 * len(x) and not found[40 + i].kept for i, x in enumerate(mixed))
    assert found[103].n_removed_words == 7


def test_url_trie_equals_join(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([None, "x", "http://A.example.org/es/1", "http://example.org/en/12?q", "http://b.com/fr/", "http://com/de/x", "http://org", "http://xorg/"])], "page_id long, url string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    trie, joined = ({r.page_id: tuple(r) for r in urls.judge(pages, rules, max_rules=n).collect()} for n in (100, 1))
    assert trie == joined and [trie[i][3] for i in range(8)] == [None, None, "example.org/es/", "example.org/en/1", "com/fr/", "com/de/", None, None]


def test_unigram_counts_are_viterbi():
    v = unigram.Vocabulary.from_ranks(["▁", "a", "b", "▁a", "ab", "▁ab", "bb", "aba"])
    best = lambda w: max(((s, -n) for s, n in paths(w)))

    def paths(w):
        if not w:
            return [(0.0, 0)]
        heads = [(w[:k], v.scores[w[:k]], 1) for k in range(1, len(w) + 1) if w[:k] in v.scores] or [(w[0], v.unknown, len(w[0].encode()))]
        return [(s + rest, n + m) for h, s, n in heads for rest, m in paths(w[len(h) :])]

    words = {"▁" + "".join(random.Random(i).choice("abé") for _ in range(i % 8)) for i in range(80)}
    for w, n in v.counts(words).items():
        assert any(abs(s - best(w)[0]) < 1e-9 and m == n for s, m in paths(w))


def test_license_notices(spark):
    texts = [None, "no notice", "x y\nReleased under the MIT License.\nz", "This work is licensed under the GNU General Public License, version 2.", "A license to kill"]
    texts += ["Licensed under the Apache License, Version 2.0\nReleased under the MIT License.", "word " * 300 + "Released under the MIT License. " + "tail " * 300, "see: distributed under the terms of the GPLv3.", "# SPDX-License-Identifier: MIT", ""]
    found = {}
    for r in licenses.scan(docs_of(spark, texts)).collect():
        found.setdefault(r.doc_id, []).append((r.license, r.confirmed))
    mit = [("MIT", True)]
    assert found == {2: mit, 3: [("GPL-2.0", True)], 5: [("Apache-2.0", True), *mit], 6: mit, 7: [("GPL-3.0", True)], 8: mit}
    assert licenses.scan(docs_of(spark, [])).count() == 0 and licenses.scan(docs_of(spark, texts * 2)).where("confirmed").count() == 14
    assert licenses.scan(spark.createDataFrame([(None, texts[3], 1)], "doc_id long, text string, license long")).first()[:3] == (None, 0, "GPL-2.0")


def test_license_notices_that_differ_in_a_word_are_not_confirmed(spark):
    gpl = "This work is licensed under the GNU {}General Public License, version {}."
    texts = [gpl.format("Lesser ", 3), gpl.format("Affero ", 3), gpl.format("", 1), gpl.format("", 4), "This work is not licensed under the MIT License.", "Not released under the MIT License."]
    texts += ["Licensed under the Apache License, Version 1.1.", licenses.TEMPLATES["MIT"][1].replace("obtaining", "getting"), "Released under the MIT License 2.0"]
    found = {r.doc_id: r for r in licenses.scan(docs_of(spark, texts)).collect()}
    assert [found[i].license for i in range(3)] == ["LGPL-3.0", "AGPL-3.0", "GPL-1.0"] and all(found[i].confirmed for i in range(3))
    assert not any(found[i].confirmed for i in range(3, 9) if i in found)
    assert found[7].license == "MIT" and found[7].changed == ["-obtaining", "+getting"] and found[5].changed == ["+not"]


def test_confirmed_licenses_are_those_of_brute_force(spark):
    scanner = licenses.Scanner(licenses.notices_by_license(), 4)
    for name, notices in licenses.notices_by_license().items():
        for notice in notices:
            assert (name, True) in [(x["license"], x["confirmed"]) for x in scanner.scan(f"Some text.\n{notice}\nMore.")]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null")
    expected = set()
    for r in docs.collect():
        own = f" {' '.join(licenses.words(r.text))} "
        expected |= {(r.doc_id, name) for notice, name in scanner.known.items() if f" {' '.join(notice)} " in own}
    assert {(r.doc_id, r.license) for r in licenses.scan(docs).where("confirmed").collect()} == expected and expected


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    held = [(scores[r.doc_id] >= TOXIC, bool(r.toxic)) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    toxic, clean = [x for x, y in held if y], [x for x, y in held if not y]
    assert sum(toxic) >= 0.7 * len(toxic) > 3 and sum(clean) <= 0.05 * len(clean)


def test_marginals_are_those_of_all_paths():
    rng = np.random.default_rng(2)
    move = np.log(np.array([[0.7, 0.3], [0.4, 0.6]]))
    lengths = np.array([1, 4, 6])
    emit = rng.normal(size=(3, 6))
    marginal, expected = toxicity.chain(emit, lengths, move)
    counts = np.zeros((2, 2))
    for r, n in enumerate(lengths):
        paths = list(itertools.product((0, 1), repeat=int(n)))
        weights = np.array([math.exp(sum(emit[r, t] * y + move[(0, *path)[t], y] for t, y in enumerate(path))) for path in paths])
        weights /= weights.sum()
        for t in range(n):
            assert abs(marginal[r, t] - sum(w for w, p in zip(weights, paths) if p[t])) < 1e-9
        for w, p in zip(weights, paths):
            for a, b in zip((0, *p), p):
                counts[a, b] += w
    assert np.allclose(counts, expected) and np.allclose(toxicity.chain_marginals(emit, lengths, move), marginal)


def test_toxicity_sample_is_bounded(spark):
    docs = docs_of(spark, ["same"] * 50).select(F.lit(1).cast("long").alias("doc_id"), "text", F.lit(0).alias("rid")).unionByName(docs_of(spark, [None, "x" * 1000, "y" * 1000, "z"]).select("doc_id", "text", F.lit(0).alias("rid")))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    assert len(toxicity.sample(docs, labels, toxicity.Fit(max_docs=1))[0]) == 1
    texts, _ = toxicity.sample(docs, labels, toxicity.Fit(max_bytes=1100))
    assert 0 < sum(map(len, texts)) <= 1100 and len(toxicity.sample(docs, labels)[0]) <= 4


@pytest.mark.parametrize("texts", [[None], ["", " \n"]])
def test_toxicity_of_empty_texts(spark, texts):
    model = toxicity.Model({"=x": 9.0}, -4.0, np.log(np.array([[0.9, 0.1], [0.5, 0.5]])))
    assert [r.score for r in toxicity.score(docs_of(spark, texts), model).collect()] == [0.0] * len(texts)
