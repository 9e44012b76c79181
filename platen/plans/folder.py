"""Runs over files and folders: what is due is listed, read, digitised and written, and figures are gathered on the way."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from platen.operators.models import Models
from platen.options import Options, check_output, inputs_of
from platen.plans.digitise import digitised
from platen.sources import images, outputs
from platen.sources.scratch import kept
from platen.sources.storage import opened

#: Files that are read and digitised in one go: their paths go through the driver, as Spark's own listing does, their contents never.
FILES = 20_000
#: Characters that Spark takes for patterns in a path.
_PATTERN = re.compile(r"([\\{}\[\]*?])")


@dataclass
class Figures:
    """What a run has come to: files that were there, passed over as done, read, failed; objects found; crops written. Messages: path and reason of each failure are rows of the result."""

    found: int = 0
    done: int = 0
    read: int = 0
    failed: int = 0
    objects: int = 0
    crops: int = 0
    observed: list[Observation] = field(default_factory=list, repr=False)

    def add(self) -> None:
        """Take in what the last jobs have observed, in the pass that wrote their crops."""
        for o in self.observed:
            got = o.get
            self.objects += got["objects"] or 0
            self.crops += got["crops"] or 0
        self.observed.clear()


def listing(spark: SparkSession, path: str) -> DataFrame | None:
    """(path, length) of a file, or of the image files directly in a folder, by name alone: no content is read. None if there is nothing."""
    extensions = "|".join(e for own in outputs.EXTENSIONS.values() for e in own)
    try:
        files = spark.read.format("binaryFile").load(_PATTERN.sub(r"\\\1", path)).select("path", "length")
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    one = F.col("path").endswith("/" + path.rstrip("/").rsplit("/", 1)[-1])
    return files.where(one | F.col("path").rlike(rf"(?i)\.({extensions})$"))


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether a path is one file, and not a folder."""
    bare = lambda p: re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", p if ":" in p else os.path.abspath(p)).rstrip("/")
    found = listing(spark, path)
    rows = [] if found is None else found.select("path").limit(2).collect()
    return len(rows) == 1 and bare(rows[0].path) == bare(path)


def due(spark: SparkSession, path: str, output_dir: str, overwrite: bool = False) -> DataFrame:
    """The files of a folder that have no output yet: no file in output_dir starts with their stem and an underscore. All of them to overwrite."""
    files = listing(spark, path)
    if files is None:
        raise FileNotFoundError(path)
    if overwrite:
        return files
    try:
        there = spark.read.format("binaryFile").load(_PATTERN.sub(r"\\\1", output_dir)).select(outputs.file_name(F.col("path")).alias("name"))
    except AnalysisException:
        return files
    return outputs.not_done(files, there)


def written(crops: DataFrame) -> DataFrame:
    """Crops (out_path, content, ..) to the same rows without content, each file written whole or not at all by the task that has it; so a task may run twice."""
    columns = [c for c in crops.columns if c not in ("content", "runs")]
    kind = crops.select(*columns).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("out_path"), batch.column("content"), strict=True):
                if path.as_py() is not None and content.as_py() is not None:
                    system, place = opened(path.as_py())
                    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    part = f"{place}.{id(batch):x}.part"
                    with system.open_output_stream(part) as f:
                        f.write(content.as_buffer())
                    system.move(part, place)
            yield batch.select(columns)

    return crops.select(*columns, "content").mapInArrow(run, kind)


def _batches(spark: SparkSession, files: DataFrame) -> Iterator[list[str]]:
    held: list[str] = []
    for r in files.select("path").orderBy("path").toLocalIterator():
        held.append(r.path)
        if len(held) == FILES:
            yield held
            held = []
    if held:
        yield held


def run(
    spark: SparkSession, paths: list[str], options: Options = Options(), *, single: str | None = None, models: Models = Models(), masks: DataFrame | None = None, output: str | None = None, output_dir: str | None = None  # noqa: B008
) -> tuple[DataFrame, Figures]:
    """Digitise files and folders: (path, obj_idx, area, angle_note, out_w, out_h, out_path, error, ..) of each crop, and figures of the run.

    A folder's outputs go to output_dir or else to the folder itself; those of its files that have outputs are passed over, and never opened, unless options say overwrite. One
    file alone fails as a whole; of several inputs, and in a folder, a failed file is a row with the reason. masks: rows by path, if no model finds them.
    """
    inputs = inputs_of(paths, single)
    single_file = {p: is_file(spark, p) for p in inputs}
    check_output(output, output_dir, inputs, single_file[inputs[0]])
    figures, results = Figures(), []
    for path in inputs:
        files = listing(spark, path)
        if files is None:
            raise FileNotFoundError(path)
        target = output_dir if single_file[path] or output_dir is not None else path
        wanted = files if single_file[path] else due(spark, path, target, options.overwrite)
        total, left = files.count(), wanted.count()
        figures.found, figures.done = figures.found + total, figures.done + total - left
        for batch in _batches(spark, wanted):
            read = images.decode_images(content_of(spark, batch))
            crops, shown = digitised(read, masks, options, models=models, output=output if single_file[path] else None, output_dir=target, fail_fast=len(inputs) == 1 and single_file[path])
            seen = Observation()
            figures.observed.append(seen)
            observed = written(crops).observe(seen, F.count("obj_idx").alias("objects"), F.count(F.when(F.col("error").isNull(), 1)).alias("crops"))
            results.append(kept(observed, "run"))
            if shown is not None:
                kept(written(shown), "overlays")
            figures.add()
            figures.read += len(batch)
            figures.failed += results[-1].where("obj_idx is null").select("path").distinct().count()
    if not results:
        empty = spark.createDataFrame([], "path string, obj_idx int, out_path string, error string")
        return empty, figures
    whole = results[0]
    for more in results[1:]:
        whole = whole.unionByName(more)
    return whole, figures


def content_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length, content, format) of these files alone."""
    files = spark.read.format("binaryFile").load([_PATTERN.sub(r"\\\1", p) for p in paths])
    return images.with_format(files)
