"""Quality rules: base measures of each text, and lines that recur over the documents of a host. DataFrame expressions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platen.llm.common import ascii_words, join_same, small, written

#: Words in a window that may repeat within a text.
SPAN = 8
HAS_WORD = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Limits:
    """Base: fewest words, and percent of words in repeated windows. Method: a line counts as frequent if over least_docs
    documents, and over share_of_host of its host's, hold it, copies of a text being one; a document is depleted if fewer than least_left
    words, or than share_left of its words, are left without frequent lines."""

    least_words: int = 20
    repeat_percent: int = 30
    least_docs: int = 20
    share_of_host: float = 0.01
    least_left: int = 5
    share_left: float = 0.2


def measures(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """A row for each row of docs (doc_id, rid, text): doc_id, rid, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(HAS_WORD))
    base = docs.select("doc_id", "rid", ascii_words(F.col("text")).alias("words"), lines.alias("lines"), (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"))
    windows = F.when(F.size("words") >= SPAN, F.transform(F.sequence(F.lit(1), F.size("words") - (SPAN - 1)), lambda i: F.xxhash64(F.slice("words", i, F.lit(SPAN))))).otherwise(F.array().cast("array<bigint>"))
    base = base.select(
        "doc_id", "rid", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), windows.alias("windows"),
    )
    # few texts have a window twice; the others need no sort
    ordered = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    base = base.select(*(c for c in base.columns if c != "windows"), ordered.alias("s"))
    twin = lambda x, i: x.h.eqNullSafe(F.get("s", i - 1).h) | x.h.eqNullSafe(F.get("s", i + 1).h)
    places = F.sort_array(F.transform(F.filter("s", twin), lambda x: x.i))
    base = base.select(*(c for c in base.columns if c != "s"), places.alias("p"))
    gaps = F.transform("p", lambda x, i: F.least(F.lit(SPAN), F.coalesce(F.get("p", i + 1) - x, F.lit(SPAN))))
    repeated = F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    base = base.select(*(c for c in base.columns if c != "p"), repeated.alias("n_repeat_words"))
    failed = (F.col("n_words") < limits.least_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words"))
    return base.withColumn("base_failed", failed)


def line_hashes(text: Column) -> Column:
    """MD5 of each line that has a word, lower-cased, with runs of digits as 0 and without outer spaces; repeats included."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[0-9]+", "0")
    return F.transform(F.filter(F.split(plain, "\n"), lambda x: x.rlike(HAS_WORD)), lambda x: F.md5(F.trim(x).cast("binary")))


def removed_words(docs: DataFrame, limits: Limits = Limits(), broadcast_rows: int = 2_000_000) -> DataFrame:  # noqa: B008
    """(doc_id, rid, removed): words in frequent lines, for the documents (doc_id, rid, host, text) that have any.

    First, documents are counted for each host and line hash, with partial sums; only lines of over least_docs documents go on. Of
    these, each distinct text counts once, as the sequence of its line hashes, so a text that many exact copies repeat isn't
    taken for a frequent line. Hosts and lines that hold a large part of the rows are summed before any shuffle.
    """
    hashed = docs.select("doc_id", "rid", F.coalesce("host", F.lit("")).alias("host"), line_hashes(F.col("text")).alias("lines"))
    host_line = F.xxhash64("host", "line")
    first = hashed.select("host", F.explode(F.array_distinct("lines")).alias("line")).select(host_line.alias("key")).groupBy("key").count().where(F.col("count") > limits.least_docs)
    wanted = small(written(first.select("key"), "lines-often"), broadcast_rows)

    spread = docs.select("doc_id", "rid", F.coalesce("host", F.lit("")).alias("host"), line_hashes(F.col("text")).alias("lines"), F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(HAS_WORD)).alias("raw"))
    each = spread.where(F.size("lines") > 0).select("doc_id", "rid", "host", F.monotonically_increasing_id().alias("row"), F.xxhash64("lines").alias("copy"), F.explode(F.arrays_zip("lines", "raw")).alias("x"))
    each = each.select("doc_id", "rid", "host", "row", "copy", F.col("x.lines").alias("line"), F.col("x.raw").alias("raw")).withColumn("key", host_line)
    met = each.join(wanted, "key").select("doc_id", "rid", "host", "row", "copy", "key", F.size(ascii_words(F.col("raw"))).alias("words"))
    rows = met.groupBy("doc_id", "rid", "host", "copy", "key", "row").agg(F.sum("words").alias("words"))  # a line as often as the row has it
    met = written(rows.groupBy("doc_id", "rid", "host", "copy", "key").agg(F.max("words").alias("words")), "lines-met")

    free = met.select("key", "copy").distinct().groupBy("key").agg(F.count("*").alias("n"))
    totals = docs.groupBy(F.coalesce("host", F.lit("")).alias("host")).agg(F.count("*").alias("of_host"))
    hosts = met.select("key", "host").distinct().join(totals, "host")
    frequent = free.join(hosts, "key").where((F.col("n") > limits.least_docs) & (F.col("n") > limits.share_of_host * F.col("of_host"))).select("key")
    frequent = small(written(frequent, "lines-frequent"), broadcast_rows)
    return met.join(frequent, "key").groupBy("doc_id", "rid").agg(F.sum("words").alias("removed"))


def judge(docs: DataFrame, host: str = "source", limits: Limits = Limits(), broadcast_rows: int = 2_000_000) -> DataFrame:  # noqa: B008
    """A row for each row of docs (doc_id, text, the host column): the measures, n_removed_words, base_failed, kept.

    A document is kept if it passes the base rules and isn't depleted by the removal of frequent lines. Null
    texts have no words (and fail), null hosts are one host, repeated rows stay and count as one document; other columns are ignored.
    """
    docs = docs.select("doc_id", F.xxhash64("text", F.col(host)).alias("rid"), F.col(host).cast("string").alias("host"), "text")
    base = measures(docs, limits)
    gone = removed_words(docs, limits, broadcast_rows)
    joined = join_same(base, gone, ["doc_id", "rid"], "left")
    n_removed = F.coalesce("removed", F.lit(0).cast("long"))
    left = F.col("n_words") - n_removed
    depleted = (n_removed > 0) & ((left < limits.least_left) | (left < limits.share_left * F.col("n_words")))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", n_removed.alias("n_removed_words"), "base_failed", (~F.col("base_failed") & ~depleted).alias("kept"))
