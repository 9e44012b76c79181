"""The pipeline's stages against brute force on a small corpus, and on null, empty and repeated rows and empty tables."""

import hashlib
import importlib
import random
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
bpe = importlib.import_module("platen.llm.bpe")
queries = importlib.import_module("platen.llm.queries")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = " ".join(f"item{i}word" for i in range(14))


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [prose(80) for _ in range(60)]
    texts += [texts[0], texts[1].upper(), texts[2] + " tail", None, "", "too short", "again and again " * 30]
    texts += [f"{prose(30)}\n{ITEM}\n{prose(30)}", f"{prose(50)} {' '.join(ITEM.split()[:9])} {prose(50)}"]
    texts += [prose(40) + " scumfiend vilewretch " + prose(10) for _ in range(40)]
    return texts


def written_tables(spark, folder, texts, toxic):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, 1, int(i in toxic)) for i in range(len(texts))]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_stages_are_those_of_brute_force(spark, tmp_path):
    texts = corpus()
    toxic = {i for i, t in enumerate(texts) if t and "scumfiend" in t}
    folder = written_tables(spark, tmp_path / "t", texts, toxic)
    docs, kept, had = spark.read.parquet(f"{folder}/documents.parquet"), {}, set(range(len(texts)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id for r in docs.collect()}
    short = {i for i, t in enumerate(texts) if len((t or "").split()) < 20 or "again and again" in t}
    assert kept["quality"] == had - short
    assert kept["toxicity"] == kept["quality"] - toxic
    left = sorted(kept["toxicity"])
    near = lambda a, b: len(shingles(texts[a]) & shingles(texts[b])) >= 0.8 * len(shingles(texts[a]) | shingles(texts[b]))
    assert kept["simhash"] == {b for b in left if not any(near(a, b) for a in left if a < b)}
    spoiled = {i for i in left if ITEM.split()[:10] == re.findall(r"item\w+", texts[i])[:10]}
    assert spoiled and kept["decontamination"] == kept["simhash"] - spoiled
    encoder = bpe.Encoder(queries.tokenizer_path("word_bpe_49k.json")).tokenizer
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == kept["decontamination"] and len(rows) == len(kept["decontamination"])
    for r in rows:
        ids = encoder.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(encoder.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("texts", [[], [None, "", " \n"]])
def test_pipeline_of_nothing(spark, tmp_path, texts):
    assert corpus_pipeline.run(spark, written_tables(spark, tmp_path / "t", texts, set())).collect() == []


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_null_ids_and_clean_repeats(spark, tmp_path, name):
    texts = corpus()[:40]
    folder = written_tables(spark, tmp_path / "t", texts, set())
    rows = [(None, texts[3], None, None, None), (5, texts[5], "en", "s", 1), (5, texts[5], "en", "s", 1), (6, None, "en", "s", 0)]
    out = dict(corpus_pipeline.STAGES)[name](spark, spark.createDataFrame(rows, DOCS), folder).collect()
    found = [r.doc_id for r in out]
    assert found.count(5) == (1 if name == "simhash" else 2) and None in found and (6 in found) == (name != "quality")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_reject_rows_not_ids(spark, tmp_path, name):
    texts = corpus()
    good, bad = texts[:40], {"quality": "too short", "toxicity": texts[40] and next(t for t in texts if t and "scumfiend" in t), "simhash": texts[0].upper(), "decontamination": next(t for t in texts if t and ITEM in t)}[name]
    folder = written_tables(spark, tmp_path / "t", texts, {i for i, t in enumerate(texts) if t and "scumfiend" in t})
    known = [(i, t) for i, t in enumerate(texts) if t and len(t.split()) >= 20 and i >= 4] if name == "toxicity" else []
    rows = [(100 + i, t, "en", "s", 1, 1, 1) for i, t in enumerate(good[:1])] + [(None, good[1], None, "s", 1, 1, 1), (None, bad, None, "s", 1, 1, 1), (200, good[2], "en", "s", 1, 1, 1), (200, bad, "en", "s", 1, 1, 1), (300, good[3], "en", None, 1, None, None)]
    rows += [(i, t, "en", "s", 1, 1, 1) for i, t in known]
    docs = spark.createDataFrame(rows, DOCS + ", __id long, rid long")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, folder)
    kept = {(r.doc_id, r.text) for r in out.collect()}
    assert {(None, good[1]), (200, good[2]), (300, good[3]), (100, good[0])} <= kept and out.columns == docs.columns
    assert (None, bad) not in kept and (200, bad) not in kept


def test_only_exact_similarity_of_four_fifths_makes_copies(spark, tmp_path):
    rng = random.Random(9)
    prose = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    texts = []
    for changed in (3, 5, 6):  # of 40 shingles: similarities 0.86, 0.78, 0.74
        for _ in range(20):
            base = prose(44)
            texts += [" ".join(base), " ".join(base[: 44 - changed] + prose(changed))]
    base = prose(44)
    texts += [" ".join(base), " ".join(base[:41] + prose(3)), " ".join(prose(3) + base[3:]), " ".join(base + base[:4] * 9)]  # a star, and repeats that are one shingle each
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash"](spark, docs, "").collect()}
    near = lambda a, b: len(shingles(texts[a]) & shingles(texts[b])) >= 0.8 * len(shingles(texts[a]) | shingles(texts[b]))
    expected = {b for b in range(len(texts)) if not any(near(a, b) for a in range(b))}
    assert kept == expected and len(expected) == 101


def test_the_sample_of_toxicity_starts_no_python_workers(spark, monkeypatch):
    made, plain = [], type(spark).createDataFrame

    def noted(self, *a, **b):
        made.append(plain(self, *a, **b))
        return made[-1]

    docs = plain(spark, [(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    labels = plain(spark, [(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    monkeypatch.setattr(type(spark), "createDataFrame", noted)
    texts, toxic = importlib.import_module("platen.llm.toxicity").sample(docs, labels)
    assert len(texts) > 20 and [int(t.split()[1]) % 2 for t in texts] == toxic
    assert made and all("LogicalRDD" not in d._jdf.queryExecution().optimizedPlan().toString() for d in made)


def test_a_worker_drops_what_the_operator_before_has_kept():
    common, simhash = importlib.import_module("platen.llm.common"), importlib.import_module("platen.llm.simhash")
    same = common.sparing(lambda batches: batches, bpe.forget)
    assert list(same(iter([1, 2]))) == [1, 2]
    kept = bpe.encoder(queries.tokenizer_path("word_bpe_49k.json"))
    assert list(same(iter([]))) == [] and bpe.encoder(queries.tokenizer_path("word_bpe_49k.json")) is kept
    assert list(common.sparing(lambda batches: batches, simhash.forget)(iter([3]))) == [3] and not bpe._encoders
    assert len(simhash.shingle_set(b"some words of a text", 2)) == 4 and simhash._words
    assert list(common.sparing(lambda batches: batches)(iter([4]))) == [4] and not simhash._words
    shingled = common.sparing(lambda batches: (simhash.shingle_set(x, 2) for x in batches), simhash.forget, keeps=False)
    assert [len(x) for x in shingled(iter([b"three more words"]))] == [2] and not simhash._words


def test_cuts_do_not_depend_on_slabs(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh \n") for _ in range(200_000)).encode()
    own = bpe.cuts(text)
    bpe.forget()
    monkeypatch.setattr(bpe, "SLAB", 1 << 20)
    whole = bpe.cuts(text)
    bpe.forget()
    assert own == whole and len(own) > 30
