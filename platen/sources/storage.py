"""Files of any kind as a Spark data source: reading by a budget of bytes, writing that is committed or leaves nothing."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from platen.sources.outputs import EXTENSIONS

#: Bytes of files that a task reads, unless the option "bytes" says otherwise.
BYTES = 64 << 20
_SCHEMA = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within: local ones, and what pyarrow can reach (S3, GCS, HDFS)."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), posixpath.abspath(path))


@dataclass
class Part(InputPartition):
    """Files that one task reads."""

    files: list[tuple[str, int]]


def parts_of(files: list[tuple[str, int]], budget: int) -> list[Part]:
    """Files in order, put together as long as they keep to the budget; a larger one stands alone."""
    out: list[Part] = []
    size = 0
    for path, n in files:
        if not out or size + n > budget:
            out.append(Part([]))
            size = 0
        out[-1].files.append((path, n))
        size += n
    return out


class ScansReader(DataSourceReader):
    def __init__(self, path: str, budget: int) -> None:
        self.path, self.budget = path, budget

    def partitions(self) -> list[InputPartition]:
        system, path = opened(self.path)
        found = [system.get_file_info(path)]
        if found[0].type == fs.FileType.Directory:
            known = {e for own in EXTENSIONS.values() for e in own}
            found = [f for f in system.get_file_info(fs.FileSelector(path)) if f.extension.lower() in known]
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File)
        if found and not files and found[0].type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        return parts_of(files, self.budget) or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        for path, _ in partition.files:
            with system.open_input_stream(path) as f:
                content = f.read()
            yield pa.RecordBatch.from_pylist([{"path": path, "length": len(content), "content": content}], _SCHEMA)


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has written, under passing names, with the names that they are to have."""

    moves: list[tuple[str, str]]


class FilesWriter(DataSourceArrowWriter):
    """Rows with a path and content as files. A task writes to a folder of its own; at the end all files of tasks that count get their names, or all folders go."""

    def __init__(self, folder: str) -> None:
        self.folder, self.stage = folder.rstrip("/"), f"{folder.rstrip('/')}/.part-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, stage = opened(self.stage)
        own, moves = f"{stage}/{uuid.uuid4().hex}", []
        system.create_dir(own, recursive=True)
        for batch in iterator:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                if name.as_py() is None or content.as_py() is None:
                    continue
                if posixpath.isabs(name.as_py()) or ".." in name.as_py().split("/"):
                    raise ValueError(f"{name.as_py()} is not below the folder")
                part = f"{own}/{len(moves)}"
                with system.open_output_stream(part) as f:
                    f.write(content.as_buffer())
                moves.append((part, name.as_py()))
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        system, stage = opened(self.stage)
        _, folder = opened(self.folder)
        made: set[str] = set()
        for message in messages:
            for part, name in message.moves if message else ():
                place = f"{folder}/{name}"
                if (parent := posixpath.dirname(place)) not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                system.move(part, place)
        system.delete_dir(stage) if system.get_file_info(stage).type == fs.FileType.Directory else None

    def abort(self, messages: list[Written | None]) -> None:
        system, stage = opened(self.stage)
        if system.get_file_info(stage).type == fs.FileType.Directory:
            system.delete_dir(stage)


class Scans(DataSource):
    """format("scans"): load(folder or file) gives (path, length, content), a task for each "bytes" of files; rows (path, content) are saved as files below a folder."""

    @classmethod
    def name(cls) -> str:
        return "scans"

    def schema(self) -> str:
        return "path string, length long, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ScansReader(self.options["path"], int(self.options.get("bytes", BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        missing = {"path", "content"} - set(schema.names)
        if missing:
            raise ValueError(f"rows lack {', '.join(sorted(missing))}")
        return FilesWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Scans)

