"""The corpus pipeline: documents go through STAGES, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platen.llm import bpe, decontaminate, quality, simhash, toxicity
from platen.llm.common import small, table, written
from platen.llm.queries import TOXIC, tokenizer_path

#: Rejected rows are broadcast up to so many, and within a bound of bytes; beyond, the join shuffles.
BROADCAST_ROWS = 2_000_000


def row_key() -> Column:
    """Tells rows apart: a hash of id, text and source. Rows with all three equal share every verdict."""
    return F.xxhash64(F.col("doc_id"), F.lit("|"), F.col("text"), F.lit("|"), F.col("source"))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, source) with the row's key in the place of its id, for operators that judge rows: ids may be null or repeat."""
    return docs.select(row_key().alias("doc_id"), "text", "source")


def without(docs: DataFrame, rejected: DataFrame, label: str) -> DataFrame:
    """The rows whose key isn't among the rejected ones: the table of rejections is small, so texts needn't move."""
    name = f"key_{uuid.uuid4().hex}"  # no column of the documents
    keys = small(written(rejected.select(F.col("doc_id").alias(name)).distinct(), f"rejected-{label}"), BROADCAST_ROWS)
    return docs.join(keys, row_key() == F.col(name), "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or that are depleted by the removal of frequent lines, go.

    Each row is judged by itself, whatever its id: null and empty texts fail, rows with a null or a repeated id are kept or rejected by their
    text and source, repeated rows alike; a null source is a host of its own. Other columns pass through, whatever their names.
    """
    return without(docs, quality.judge(keyed(docs)).where("not kept"), "quality")


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of TOXIC or more go; the model learns from the labels of what is left.

    Each row is judged by its text: null and empty texts score 0 and stay, null and repeated ids and repeated rows make no
    difference. Without labelled documents nothing scores. Other columns pass through, whatever their names.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return without(docs, toxicity.score(keyed(docs), model).where(F.col("score") >= TOXIC), "toxic")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that are alike to one of a smaller doc_id: sets of five-word shingles, exact Jaccard similarity of 0.8 or more.

    So no two that stay are alike, and of a chain of texts, each alike to the next, those that have no smaller neighbour stay.

    One of each group of copies stays, also among rows with one id or without any (null ids come last); of rows equal in id and text
    one stays. Null, empty and wordless texts are copies of each other. Other columns pass through, whatever their names.
    """
    gone = simhash.copies(docs, 5, simhash.Search.similar()).distinct()
    left = simhash.without_rows(docs, small(written(gone, "rejected-copies"), BROADCAST_ROWS))
    return simhash.without_repeats(left, BROADCAST_ROWS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Each row is judged by its text: null and empty texts stay, null and repeated ids and repeated rows make no difference. Items
    without words match nothing. Other columns pass through, whatever their names.
    """
    found = decontaminate.contamination(keyed(docs), table(spark, sf_dir, "benchmark"))
    return without(docs, found.where("contaminated"), "benchmark")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), and digests of the ids and of the text decoded from them.

    A row for each row, with null and repeated ids as they are; null text counts as empty and has no ids; other columns go.
    """
    path = tokenizer_path("word_bpe_49k.json")
    both = bpe.encode(docs, path, with_decoded=True)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "ids")


STAGES = [("quality", quality_rules), ("toxicity", toxic_documents), ("simhash", near_duplicates), ("decontamination", benchmark_passages), ("bpe", token_ids)]

#: SQL has neither the fitted model, nor the hashes of the fingerprints, nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
