"""Recorded answers of model services as a data source.

`register(spark)` makes the format `recorded_responses` known: JSON lines, each an object with request_id, provider,
model_id, status and body (an object, or the text that came). A file is cut into ranges of
`split_bytes` (32 MB unless the option says else), a range is a partition, and a line belongs to the range in which it
begins. Files are opened by their address on the executors, so any store that the address names will do.
A line that holds no such object is a row whose `problem` says so, with the line as body."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, offset long, request_id string, provider string, model_id string, status int, body string, problem string"
_KIND = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("request_id", pa.string()), ("provider", pa.string()), ("model_id", pa.string()), ("status", pa.int32()), ("body", pa.string()), ("problem", pa.string())])
SPLIT_BYTES = 32 << 20
BATCH_ROWS = 1000


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


def _text(value) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def parse_line(line: bytes) -> tuple:
    """(request_id, provider, model_id, status, body, problem)."""
    text = line.decode("utf-8", "replace").rstrip("\r\n")
    try:
        row = json.loads(text)
    except ValueError:
        row = None
    if not isinstance(row, dict):
        return None, None, None, None, text, "the line is not a recorded response"
    status = row.get("status")
    if isinstance(status, bool) or not isinstance(status, int) or abs(status) >= 1 << 31:
        return _text(row.get("request_id")), _text(row.get("provider")), _text(row.get("model_id")), None, _text(row.get("body")), "the record has no status"
    return _text(row.get("request_id")), _text(row.get("provider")), _text(row.get("model_id")), status, _text(row.get("body")), None


class Reader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        system, root = self._open()
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise ValueError(f"no recorded responses at {self.path}")
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        kept = sorted((f.path, f.size) for f in files if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
        return [Range(name, at, min(at + self.split_bytes, size)) for name, size in kept for at in range(0, size, self.split_bytes)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = self._open()
        rows: list[tuple] = []
        with io.BufferedReader(system.open_input_file(partition.file), 1 << 20) as f:
            at = partition.start
            if at:  # the line that is open at the start belongs to the range before
                f.seek(at - 1)
                at += len(f.readline()) - 1
            while at < partition.end:
                line = f.readline()
                if not line:
                    break
                if line.strip():
                    rows.append((partition.file, at, *parse_line(line)))
                at += len(line)
                if len(rows) >= BATCH_ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KIND.types, strict=True)], schema=_KIND)


class RecordedResponses(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded_responses"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        path = self.options.get("path")
        if not path:
            raise ValueError("recorded_responses needs a path")
        return Reader(path if "://" in path or path.startswith("file:") else f"file://{path}", int(self.options.get("split_bytes", SPLIT_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordedResponses)


def read(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    register(spark)
    return spark.read.format("recorded_responses").option("split_bytes", str(split_bytes)).load(path)
