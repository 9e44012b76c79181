"""Benchmark decontamination: a prefix-filtered set join on shingles ordered by rarity, verified word by word.

DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platen.llm.common import LOWER, UPPER, join_same, small, written

#: What stands between words once A-Z are small, and once letters are capitals.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_CAPITAL_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), "")


def folded_words(text: Column) -> Column:
    """The same words at the same places with all letters as capitals: much faster, and equal where the words are."""
    return F.array_remove(F.split(F.upper(F.coalesce(text, F.lit(""))), NOT_CAPITAL_WORD), "")


def shingles(words: Column, size: int) -> Column:
    """A hash for each place: of the word and the next one (size 2; none at the last place), or of the word (size 1)."""
    if size == 1:
        return F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > 1, F.transform(F.slice(words, F.lit(1), F.size(words) - 1), lambda w, i: F.xxhash64(w, F.get(words, i + 1)))).otherwise(F.array().cast("array<bigint>"))


def windows_of(items: DataFrame, window: int = 10) -> DataFrame:
    """(win, len, item_id): the distinct windows of window words of each item; the whole of a shorter one, none of an empty one."""
    words = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    cut = words.select("item_id", "words", F.explode(starts).alias("start")).select("item_id", F.slice("words", F.col("start") + 1, F.lit(window)).alias("part"))
    return cut.select(F.array_join("part", " ").alias("win"), F.size("part").alias("len"), "item_id").distinct()


def _tokens(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc_id, rid, n_words, size, pos, token): the shingles of all documents, with the hashes that shingles() gives.

    Words and their followers are unnested side by side and hashed as rows: that is compiled, functions over arrays aren't.
    """
    worded = docs.select("doc_id", "rid", folded_words(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    fewer = F.greatest(F.col("n_words") - 1, F.lit(0))
    out = None
    for n in sizes:
        ahead = [F.slice("words", F.lit(i + 1), fewer).alias(f"w{i}") for i in range(n)] if n > 1 else [F.col("words").alias("w0")]
        rows = worded.select("doc_id", "rid", "n_words", *ahead).select("doc_id", "rid", "n_words", F.posexplode(F.arrays_zip(*(f"w{i}" for i in range(n)))).alias("pos", "x"))
        part = rows.select("doc_id", "rid", "n_words", F.lit(n).alias("size"), "pos", F.xxhash64(*(f"x.w{i}" for i in range(n))).alias("token"))
        out = part if out is None else out.unionAll(part)
    return out


def hits(docs: DataFrame, items: DataFrame, window: int = 10, broadcast_rows: int = 2_000_000) -> DataFrame:
    """(doc_id, rid, n_hit, items) of the documents (doc_id, rid, text) in which a window occurs.

    Shingles of two words (one, for windows of one word) are counted over all documents; a window's prefix is its rarest
    shingle, which a document with the window must have. Windows with a shingle that no document has are dropped.
    Prefixes meet the documents' shingles on their hash; places where the window would stand out of the text are dropped;
    the words at the places that are left are compared with the windows, whole. The tables on the benchmark's side are broadcast up to
    broadcast_rows rows and a bound of bytes, beyond that joined by a shuffle that Spark may split; of the documents' side, ids are.
    """
    owners = written(windows_of(items, window), "windows")
    wins = owners.select("win", "len").distinct().withColumn("words", F.transform(F.split("win", " "), lambda w: F.upper(w)))
    size = F.when(F.col("len") > 1, 2).otherwise(1)
    token = F.when(F.col("len") > 1, shingles(F.col("words"), 2)).otherwise(shingles(F.col("words"), 1))
    own = written(wins.select("win", "len", size.alias("size"), F.posexplode(token).alias("offset", "token")), "window-tokens")
    sizes = [r[0] for r in own.select("size").distinct().orderBy("size").collect()]
    if not sizes:
        return docs.select("doc_id", "rid", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items")).where("false")

    keys = small(written(own.select("size", "token").distinct(), "window-keys"), broadcast_rows)
    counts = written(_tokens(docs, sizes).select("size", "token").join(keys, ["size", "token"]).groupBy("size", "token").count(), "token-counts")
    ranked = own.join(counts, ["size", "token"], "left").groupBy("win", "len", "size").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "token", "offset")).alias("first"))
    # where a window would start and how long it is, whichever it is: at most some window * window rows a token
    prefix = ranked.where("first.count > 0").select("size", F.col("first.token").alias("token"), F.col("first.offset").alias("offset"), "len").distinct()
    prefix = small(written(prefix, "window-prefixes"), broadcast_rows)

    start = F.col("pos") - F.col("offset")
    met = _tokens(docs, sizes).join(prefix, ["size", "token"]).where((start >= 0) & (start + F.col("len") <= F.col("n_words")))
    places = met.groupBy("doc_id", "rid").agg(F.collect_set(F.struct(start.alias("start"), "len")).alias("places"))
    cands = written(places, "window-candidates")

    # only texts with a candidate go on; their places are as many as they have words at most
    ids = small(written(cands.select("doc_id", "rid").distinct(), "window-documents"), broadcast_rows)
    texts = join_same(docs.select("doc_id", "rid", "text"), ids, ["doc_id", "rid"], "left_semi").dropDuplicates(["doc_id", "rid"])
    exact = join_same(texts, small(cands, broadcast_rows), ["doc_id", "rid"]).select("doc_id", "rid", words_of(F.col("text")).alias("words"), "places")
    cut = exact.select("doc_id", "rid", F.explode(F.transform("places", lambda p: F.struct(p.start.alias("start"), p.len.alias("len"), F.array_join(F.slice("words", p.start + 1, p.len), " ").alias("win")))).alias("p")).select("doc_id", "rid", "p.start", "p.len", "p.win")
    named = small(written(owners.select("win", F.col("item_id").cast("string").alias("item_id")).groupBy("win").agg(F.collect_set("item_id").alias("items")), "window-items"), broadcast_rows)
    same = cut.join(named, "win")
    spans = F.flatten(F.collect_list(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)))
    return same.groupBy("doc_id", "rid").agg(F.size(F.array_distinct(spans)).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, broadcast_rows: int = 2_000_000) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_words, n_hit, items (sorted as strings), contaminated.

    items: (item_id, text). A document word inside any occurrence of a window of an item is hit. Null and empty texts have no
    words; items without words or ids match nothing; repeated rows stay; other columns are ignored.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("rid"))
    items = items.select("item_id", "text").where("item_id is not null")
    found = hits(docs, items, window, broadcast_rows)
    counted = docs.select("doc_id", "rid", F.size(folded_words(F.col("text"))).cast("long").alias("n_words"))
    joined = join_same(counted, found, ["doc_id", "rid"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))
