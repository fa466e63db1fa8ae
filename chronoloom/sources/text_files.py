"""Texts written as files of given names, as a data source.

`write_texts(lines, path)` takes name, section, item and text: the texts of one name, in order of
section and item, are one file below `path`. Tasks write into a folder of the attempt, beside `path`, and when all have ended
that folder gets `_COMPLETE` (number of files and of bytes) and is renamed to `path` in one step: a build is whole or isn't
there. Where a task fails for good, the attempt's folder is deleted; a task that is still running then can leave files in it, never
in `path`. Within it a file is written under a name of its own and renamed, so that a repeated task writes the same
bytes again. What exists is never written over: that is an error, before anything is touched. The store must know folders (a
local or shared file system, HDFS).

A null text is empty; a null, empty or absolute name, or one with a step `.` or `..` or a first step that begins with `_`, stops the
write; an empty table gives a complete folder without files. No file is held in memory: lines reach a task
sorted and go through one open stream."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

MARK = "_COMPLETE"
SCHEMA = "name string, section int, item long, text string"


@dataclass
class Wrote(WriterCommitMessage):
    files: int
    bytes: int


def _checked(name: str | None) -> str:
    steps = (name or "").split("/")
    if name is None or name.startswith("_") or any(s in ("", ".", "..") for s in steps):
        raise ValueError(f"not a name of a file: {name!r}")
    return name


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.attempt = path.rstrip("/"), uuid.uuid4().hex  # made once, on the driver

    def _open(self):
        """The file system and the attempt's folder."""
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        return system, f"{root}._{self.attempt}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        system, root = self._open()
        stream, name, temp, files, size = None, None, "", 0, 0

        def finish():
            nonlocal stream
            if stream is not None:
                stream.close()
                stream = None
                system.move(temp, f"{root}/{name}")

        try:
            for batch in iterator:
                for key, text in zip(batch.column("name").to_pylist(), batch.column("text"), strict=True):
                    if stream is None or key != name:
                        finish()
                        name, files = _checked(key), files + 1
                        folder = f"{root}/{name}".rsplit("/", 1)[0]
                        system.create_dir(folder, recursive=True)
                        temp = f"{folder}/_{uuid.uuid4().hex}"
                        stream = system.open_output_stream(temp)
                    data = (text.as_py() or "").encode()
                    stream.write(data)
                    size += len(data)
            finish()
        except BaseException:
            if stream is not None:  # failed within a file
                stream.close()
                if system.get_file_info(temp).is_file:
                    system.delete_file(temp)
            raise
        return Wrote(files, size)

    def commit(self, messages: list[Wrote | None]) -> None:
        system, root = self._open()
        system.create_dir(root, recursive=True)
        done = [m for m in messages if m is not None]
        with system.open_output_stream(f"{root}/{MARK}") as f:
            f.write(json.dumps({"files": sum(m.files for m in done), "bytes": sum(m.bytes for m in done)}).encode())
        system.move(root, root.removesuffix(f"._{self.attempt}"))

    def abort(self, messages: list[Wrote | None]) -> None:
        from pyarrow import fs

        system, root = self._open()
        if system.get_file_info(root).type == fs.FileType.Directory:
            system.delete_dir(root)


class TextFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def write_texts(lines: DataFrame, path: str) -> None:
    """lines: name, section, item, text; one name is written by one task, so that it is one file."""
    from pyarrow import fs

    spark: SparkSession = lines.sparkSession
    system, root = fs.FileSystem.from_uri(_uri(path).rstrip("/"))
    if system.get_file_info(root).type != fs.FileType.NotFound:
        raise ValueError(f"{path} is there already and is not written again")
    spark.dataSource.register(TextFiles)
    rows = lines.selectExpr("cast(name as string) name", "cast(section as int) section", "cast(item as long) item", "text")
    rows.repartition("name").sortWithinPartitions("name", "section", "item").write.format("text_files").mode("append").save(_uri(path))


def digests(lines: DataFrame) -> DataFrame:
    """name, sha256 of each file that write_texts makes of the lines, without writing them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        name, sha, begun = None, hashlib.sha256(), False
        out = lambda: pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([sha.hexdigest()], pa.string())], names=["name", "sha256"])
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if begun and key != name:
                    yield out()
                    sha = hashlib.sha256()
                name, begun = key, True
                sha.update((text.as_py() or "").encode())
        if begun:
            yield out()

    rows = lines.select("name", "section", "item", "text").repartition("name").sortWithinPartitions("name", "section", "item")
    return rows.select("name", "text").mapInArrow(run, "name string, sha256 string")
