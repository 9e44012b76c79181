"""Helpers shared by the corpus operators: tables, shared scratch folders, checked broadcasts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII capitals and small letters, for translate(): lower-cases A-Z and nothing else.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One or more of the six ASCII white-space characters, as a Java pattern.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir).

    Without that setting a temporary folder is made in local mode, as in tests; on a cluster it is an error, for
    executors wouldn't see a folder of the driver's machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="platen-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of texts that go to Python at once, unless the session says otherwise; Spark's own bound.
BATCH, BATCH_BYTES, SPARK_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m", "67108864b"


def texts_in_batches(docs: DataFrame) -> DataFrame:
    """The same rows; from now on the session hands rows to Python in batches of BATCH_BYTES, if it has Spark's own bound: some 10,000 rows of long texts in
    buffers on both sides are more than what a worker keeps otherwise."""
    conf = docs.sparkSession.conf
    if conf.get(BATCH, None) == SPARK_BYTES:
        conf.set(BATCH, BATCH_BYTES)
    return docs


def few(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """A table of the driver's few rows by way of Arrow: rows that go through createDataFrame as they are start a daemon of its own and a Python worker a core on the executors, beside those of mapInArrow."""
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=schema))


#: Of the operators that keep something in this Python worker beyond a task: what drops it.
_kept_by: list[Callable[[], None]] = []


def begun(forget: Callable[[], None] | None) -> None:
    """What other operators keep in this worker is dropped: an executor's workers serve one operator after the other."""
    for other in [f for f in _kept_by if f is not forget]:
        _kept_by.remove(other)
        other()
    if forget and forget not in _kept_by:
        _kept_by.append(forget)


def given_back() -> None:
    """Freed memory goes back to the system: idle workers stay beside the busy ones, and what they hold adds up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def sparing(run: Run, forget: Callable[[], None] | None = None, *, keeps: bool = True) -> Run:
    """A function for mapInArrow that leaves its worker small. forget, a function of a module, drops what run keeps there: when another operator comes, or unless it keeps it for its next task, with the task."""

    def spared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun(forget)
        try:
            yield from run(batches)
        finally:
            if forget and not keeps:
                forget()
            given_back()

    return spared


#: Bytes of a table, as rows without overhead, up to which it is broadcast.
BROADCAST_BYTES = 32 << 20


def _bytes_of(name: str, kind: T.DataType) -> Column:
    """Bytes of a column's value in a row: 8, and for what has no fixed size its length (16 an element of an array)."""
    column = F.col(f"`{name}`")
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType):
        inner = F.lit(16) if not isinstance(kind.elementType, T.StringType | T.BinaryType | T.StructType | T.ArrayType) else F.octet_length(F.to_json(column)) / F.greatest(F.size(column), F.lit(1)) + 16
        return F.coalesce(F.greatest(F.size(column), F.lit(0)) * inner, F.lit(0)) + 8
    return F.lit(8)


def fits(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a written table has at most max_rows rows of max_bytes together."""
    size = sum((_bytes_of(f.name, f.dataType) for f in df.schema.fields), F.lit(16))
    rows, total = df.limit(max_rows + 1).agg(F.count("*"), F.sum(size.cast("double"))).first()
    return rows <= max_rows and (total or 0) <= max_bytes


def small(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a written table for broadcast if it fits; else leave the join to shuffle."""
    return F.broadcast(df) if fits(df, max_rows, max_bytes) else df


def ascii_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` as an array; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def within(sizes: list[int], most: int) -> list[int]:
    """Places that are taken one after the other, passing over what would go beyond the sum."""
    out, total = [], 0
    for i, n in enumerate(sizes):
        if total + n <= most:
            out.append(i)
            total += n
    return out


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null to null; the result has the keys once."""
    named = right.select(*(F.col(c).alias(f"__{c}" if c in keys else c) for c in right.columns))
    condition = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    joined = left.join(named, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*(f"__{k}" for k in keys))
