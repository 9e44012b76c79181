"""Image files in, as rows of pixels; crops out, as files."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from platen.sources import codecs
from platen.sources.batches import batched
from platen.sources.outputs import EXTENSIONS, format_of

#: What a file of a format starts with, in hexadecimal digits as a pattern. Fixed values.
MAGIC = [
    ("png", "^89504E470D0A1A0A"), ("jpeg", "^FFD8FF"), ("gif", "^474946383[79]61"), ("webp", "^52494646.{8}57454250"), ("tiff", "^(49492A00|4D4D002A)"), ("bmp", "^424D"),
    ("ico", "^00000100"), ("qoi", "^716F6966"), ("farbfeld", "^6661726266656C64"), ("openexr", "^762F3101"), ("hdr", "^233F52414449414E4345"), ("dds", "^44445320"), ("avif", "^.{8}6674797061766966"), ("pnm", "^503[1-7]"),
]
PIXELS = "path string, format string, width int, height int, channels int, depth int, data binary, error string"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content, format) of a file, or of the image files directly in a folder, told by their extension in any case; the format by
    the first bytes, else by extension. Order by path for a listing; a folder's own files only."""
    extensions = "|".join(e for own in EXTENSIONS.values() for e in own)
    files = spark.read.format("binaryFile").load(path)
    one = F.col("path").endswith("/" + path.rstrip("/").rsplit("/", 1)[-1])  # a file is taken whatever its extension
    files = files.where(one | F.col("path").rlike(rf"(?i)\.({extensions})$"))
    return with_format(files)


def with_format(files: DataFrame) -> DataFrame:
    """Files with their format by the first bytes, else by extension."""
    head = F.hex(F.substring("content", 1, 12))
    sniffed = F.coalesce(*(F.when(head.rlike(pattern), name) for name, pattern in MAGIC))
    return files.select("path", "length", "content", F.coalesce(sniffed, format_of(F.col("path"))).alias("format"))


def pixels_of(data: bytes, width: int, height: int, channels: int, depth: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if depth == 8 else "<u2").reshape(height, width, channels)


def decode_images(files: DataFrame) -> DataFrame:
    """Files (path, content, format) to rows of pixels (PIXELS), each decoded once: data is row by row, 16 bits little-endian.

    A file that can't be decoded keeps its row, with the reason as error and no pixels; null content is such a file.
    """

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for path, content, form in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row: dict[str, object] = {"path": path, "format": form}
                try:
                    image = codecs.decode(content or b"", form)
                    row |= {"width": image.shape[1], "height": image.shape[0], "channels": image.shape[2], "depth": 8 * image.itemsize, "data": image.astype(f"<u{image.itemsize}").tobytes()}
                except codecs.Unsupported as e:
                    row["error"] = f"{type(e).__name__}: {e}"
                yield row

    return files.select("path", "content", "format").mapInArrow(lambda batches: batched(decoded(batches), PIXEL_SCHEMA), PIXELS)


PIXEL_SCHEMA = pa.schema([("path", pa.string()), ("format", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("depth", pa.int32()), ("data", pa.binary()), ("error", pa.string())])


def write_files(crops: DataFrame) -> None:
    """Write content to out_path for the rows that have both; the folder must be one that all executors share. A file appears whole or not at all, so a task may run twice."""

    def save(rows: Iterator[Row]) -> None:
        for row in rows:
            os.makedirs(os.path.dirname(row.out_path) or ".", exist_ok=True)
            part = f"{row.out_path}.{os.getpid()}.part"
            with open(part, "wb") as f:
                f.write(row.content)
            os.replace(part, row.out_path)

    crops.where("content is not null and out_path is not null").select("out_path", "content").foreachPartition(save)
