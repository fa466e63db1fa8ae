"""WARC archives: writing, normalising a monolithic gzip, and reading back.

`write` makes one whole-file gzip stream for each run of records. `normalise`
inflates such a stream once, from its start to its end, rewrites every record as a
gzip member of its own and writes a sidecar index (one JSON line for each record:
its offset, length, type and identifier). `read` fetches records by the index.

Archives go to the shared folder through pyarrow's file systems. A task names its
files after its attempt and reports them in its rows, which are written as a table:
files of attempts that were lost are never listed.

Of records with equal payloads of at least `least` bytes, the one of the largest
page_id is the response and the others revisit it. The digest is bare upper-case
base32 SHA-1 of the full payload.

Defined results: a null html is an empty payload; rows of null page_id are written
with an identifier of their own and read back as null; rows that repeat the response's
page_id are responses too; a null url becomes the record's identifier; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, materialize, shared_dir

#: Bytes of records after which an archive ends.
ARCHIVE_BYTES = 32 << 20
LEVEL = 4
# The parts of the WARC 1.1 format that are used here.
VERSION = "WARC/1.1"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(kind: str, identifier: str, block: bytes, fields: list[tuple[str, str]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:{identifier}>"), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return f"{VERSION}\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    name = f"page:{page_id}" if page_id is not None else f"page:none:{uuid.uuid4().hex}"
    uri = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else f"urn:{name}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if refers_to is None:
        return record("response", name, http + payload, [*fields, ("Content-Type", "application/http; msgtype=response")])
    return record("revisit", name, http, [*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("Content-Type", "application/http; msgtype=response")])


def _files(folder: str):
    """File system and path of a folder's URI."""
    return fs.FileSystem.from_uri(folder)


def _write(folder: str):
    def run(batches):
        system, base = _files(folder)
        task = TaskContext.get()
        stem, count, stream, path, size, packer = f"{task.partitionId():05d}-{task.taskAttemptId()}", 0, None, "", 0, None
        written = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                page, url, html, refers = row
                if stream is None:
                    path = f"{base}/{stem}-{count}.warc.gz"
                    stream, packer, size = system.open_output_stream(path, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
                    count += 1
                    stream.write(packer.compress(record("warcinfo", f"file:{stem}-{count}", b"", [])))
                one = page_record(page, url, (html or "").encode(), refers)
                stream.write(packer.compress(one))
                size += len(one)
                if size >= ARCHIVE_BYTES:
                    stream.write(packer.flush())
                    stream.close()
                    written.append(path)
                    stream = None
        if stream is not None:
            stream.write(packer.flush())
            stream.close()
            written.append(path)
        if written:
            yield pa.RecordBatch.from_arrays([pa.array(written)], names=["path"])

    return run


class Records:
    """Splits inflated bytes, fed in pieces, into whole records."""

    def __init__(self):
        self.held, self.want = bytearray(), None

    def feed(self, piece: bytes):
        self.held += piece
        while True:
            if self.want is None:
                end = self.held.find(b"\r\n\r\n")
                if end < 0:
                    return
                self.want = end + 4 + int(headers(bytes(self.held[:end]))["content-length"]) + 4
            if len(self.held) < self.want:
                return
            yield bytes(self.held[: self.want])
            del self.held[: self.want]
            self.want = None


def headers(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


#: Bytes that one inflating step returns at most.
INFLATE = 4 << 20


def inflated(pieces):
    """What gzip pieces hold, in steps of at most INFLATE bytes: one member, or several in a row
    (zero bytes may stand between and after them)."""
    inflate, begun = zlib.decompressobj(31), False
    for piece in pieces:
        while piece:
            if not begun:
                piece = piece.lstrip(b"\0")
                if not piece:
                    break
            begun = True
            yield inflate.decompress(piece, INFLATE)
            piece = inflate.unconsumed_tail
            while not piece and not inflate.eof and (more := inflate.decompress(b"", INFLATE)):
                yield more
            if inflate.eof:
                piece, inflate, begun = inflate.unused_data, zlib.decompressobj(31), False
    if begun:
        raise ValueError("the stream ends inside a member")


def normalise_stream(pieces, out) -> list[dict]:
    """Inflates a whole gzip stream and writes each record to `out` as its own member; the index."""
    split, index, at = Records(), [], 0
    for piece in inflated(pieces):
        for one in split.feed(piece):
            packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            member = packer.compress(one) + packer.flush()
            out.write(member)
            head = headers(one[: one.index(b"\r\n\r\n")])
            index.append({"offset": at, "length": len(member), "type": head["warc-type"], "id": head["warc-record-id"]})
            at += len(member)
    if split.held:
        raise ValueError("the stream ends inside a record")
    return index


def _pieces(stream, size: int = 1 << 20):
    while piece := stream.read(size):
        yield piece


def _normalise(folder: str):
    def run(batches):
        system, base = _files(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                target = f"{base}/members-{TaskContext.get().taskAttemptId()}-{path.rpartition('/')[2]}"
                with system.open_input_stream(path, compression=None) as source, system.open_output_stream(target, compression=None) as out:
                    index = normalise_stream(_pieces(source), out)
                with system.open_output_stream(target + ".index.jsonl", compression=None) as out:
                    out.write("".join(json.dumps(x) + "\n" for x in index).encode())
                yield pa.RecordBatch.from_arrays([pa.array([target])], names=["path"])

    return run


def parse(one: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a page's record."""
    end = one.index(b"\r\n\r\n")
    head = headers(one[:end])
    block = one[end + 4 : end + 4 + int(head["content-length"])]
    body = block.index(b"\r\n\r\n")
    kind, name = head["warc-type"], head["warc-record-id"][1:-1].removeprefix("urn:page:")
    stated = head["warc-payload-digest"].removeprefix("sha1:")
    page = int(name) if name.lstrip("-").isdigit() else None
    size = int(headers(block[:body])["content-length"])
    if kind == "response":
        payload = block[body + 4 :]
        if len(payload) != size or digest(payload) != stated:
            raise ValueError(f"damaged record {name}")
        return page, size, stated, kind, None
    return page, size, stated, kind, int(head["warc-refers-to"][1:-1].removeprefix("urn:page:"))


def _read(folder: str):
    def run(batches):
        system, _ = _files(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with system.open_input_stream(path + ".index.jsonl", compression=None) as source:
                    index = [json.loads(x) for x in source.read().decode().splitlines()]
                rows = []
                with system.open_input_file(path) as source:
                    for x in index:
                        if x["type"] in ("response", "revisit"):
                            source.seek(x["offset"])
                            rows.append(parse(zlib.decompress(source.read(x["length"]), 31)))
                if rows:
                    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return run


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes monolithic archives under `folder` (a URI); their paths."""
    bounded_batches(pages.sparkSession, rows=200)
    source = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"], F.lit("")).alias("html"))
    source = source.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("size", F.octet_length("html"))
    # payloads that occur once need no join: only those of several pages go back to the pages
    several = source.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "last")
    marked = source.join(several, "digest", "left")
    rows = marked.select("page_id", "url", "html", F.when(F.col("page_id") != F.col("last"), F.col("last")).alias("refers_to"))
    return materialize(rows.mapInArrow(_write(folder), "path string"))


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Member-wise copies of monolithic archives, each with a sidecar index; their paths."""
    return materialize(files.repartition(max(1, files.count())).mapInArrow(_normalise(folder), "path string"))


def read(files: DataFrame, folder: str) -> DataFrame:
    """Page records of normalised archives."""
    return files.repartition(max(1, files.count())).mapInArrow(_read(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages written, normalised and read back, in a new folder of the shared one."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    system, base = _files(folder)
    system.create_dir(base)
    return read(normalise(write(pages, folder, least), folder), folder)
