"""Repeated lines across documents, found by two Bloom filters.

A line's key is the line without white space at its ends and with A-Z lower-cased; a
128-bit digest stands for it. The digests' space is cut into buckets of about Size.bucket bytes of text,
and each bucket has two Bloom filters: the first gets every digest once seen, the second those that the
first knew already. A task tells a digest once for each flush of its lines, and tells at
once which ones it saw in several documents itself, so that a line that stands in a third of
all documents costs one row for each flush. A second pass asks the second filter; only lines that it suspects
are shuffled for the exact count of documents and the choice of the document that keeps them.
Filters have no false negatives and a false positive is refuted by the count, so the result is exact.

Memory: two filters of one bucket, Size.flush lines of one task, one Arrow batch. Buckets grow
with the input, each filter stays as it is.

Defined results: a null or empty text is one empty line; a line shorter than `length`
code points never goes; all lines of a key stay in the largest doc_id that holds it, repeated ones
too; rows that share a doc_id count as one document; rows of null doc_id count as one
document that is smaller than all others; an empty table gives an empty result;
further columns of any name are kept by `drop_lines` and ignored by `report`.
"""

from __future__ import annotations

import hashlib
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, materialize, mix, parts, steps, text_bytes



class Size(NamedTuple):
    """bucket: bytes of text for one (with lines of 20 characters it has 3.3 million of them at most);
    bits: of each filter (a power of two), of which a digest sets `hashes`; flush: lines that a task gathers before it tells or asks."""

    bucket: int = 64 << 20
    bits: int = 1 << 24
    hashes: int = 4
    flush: int = 1 << 20


BLANKS = " \t\n\x0b\x0c\r"
#: Stands for a null doc_id inside.
NO_ID = -(1 << 63)

_U = np.uint64
_NOBODY = np.zeros(0, dtype=np.int64)


def cut(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets of each text's lines, and all lines."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    return np.asarray(lists.offsets, dtype=np.int64), lists.values


def digests(lines: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the lines whose key has `length` code points, and the keys' digests (n x 2)."""
    keys = pc.ascii_lower(pc.ascii_trim(lines, characters=BLANKS))
    place = np.flatnonzero(np.asarray(pc.greater_equal(pc.utf8_length(keys), length)))
    own = keys.take(pa.array(place)).cast(pa.binary()).to_pylist()
    return place, np.frombuffer(b"".join([hashlib.blake2b(k, digest_size=16).digest() for k in own]), dtype=_U).reshape(-1, 2)


def _flushes(batches, length: int, flush: int):
    """(digest, documents) of each flush: distinct digests (n x 2), the start of each one's
    documents, and the distinct documents."""
    found, ids, held = [], [], 0

    def out():
        h, d = np.concatenate(found), np.concatenate(ids)
        order = np.lexsort((d, h[:, 1], h[:, 0]))
        h, d = h[order], d[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]).any(axis=1)
        keep = new.copy()
        keep[1:] |= d[1:] != d[:-1]
        h, d, new = h[keep], d[keep], new[keep]
        start = np.flatnonzero(new)
        return h[start], np.append(start, len(d)), d

    for batch in batches:
        texts, docs = batch.column("text"), np.asarray(pc.fill_null(batch.column("doc_id"), NO_ID), dtype=np.int64)
        for at, to in steps(texts):
            offsets, lines = cut(texts.slice(at, to - at))
            place, h = digests(lines, length)
            if len(place):
                found.append(h)
                ids.append(docs[at:to][np.searchsorted(offsets, place, side="right") - 1])
                held += len(place)
            if held >= flush:
                yield out()
                found, ids, held = [], [], 0
    if held:
        yield out()


def _cells(h: np.ndarray, size: Size) -> list[np.ndarray]:
    """The bits of each digest (its second half; the first one chooses the bucket)."""
    return [(mix(h + _U(k * 0x9E3779B97F4A7C15 % (1 << 64))) & _U(size.bits - 1)).astype(np.int64) for k in range(size.hashes)]


def _runs(values: np.ndarray):
    """(value, from, to) of equal neighbours."""
    at = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else _NOBODY
    return zip(values[at].tolist(), at.tolist(), np.append(at[1:], len(values)).tolist(), strict=True)


def _tell(buckets: int, length: int, size: Size = Size()):
    """Every distinct digest of a flush: bucket, the half that the filters take, whether several documents have it."""

    def run(batches):
        for h, start, _ in _flushes(batches, length, size.flush):
            bucket = (h[:, 0] % _U(buckets)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(h[:, 1].view(np.int64)), pa.array(np.diff(start) > 1)], names=["bucket", "half", "several"])

    return run


def _filters(size: Size):
    """The second filter of each bucket that has one; rows come sorted by bucket."""

    def run(batches):
        now, once, twice = None, np.zeros(0, dtype=bool), np.zeros(0, dtype=bool)

        def full():
            if now is not None and twice.any():
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zlib.compress(np.packbits(twice).tobytes(), 1)], pa.binary())], names=["bucket", "bits"])

        for batch in batches:
            half, several = np.asarray(batch.column("half")).view(_U), np.asarray(batch.column("several").to_numpy(zero_copy_only=False))
            for bucket, at, to in _runs(np.asarray(batch.column("bucket"))):
                if bucket != now:
                    yield from full()
                    now, once, twice = bucket, np.zeros(size.bits, dtype=bool), np.zeros(size.bits, dtype=bool)
                order = np.argsort(half[at:to], kind="stable")
                h, told = half[at:to][order], several[at:to][order]
                told[:-1] |= h[1:] == h[:-1]  # digests that meet in this batch aren't in the first filter yet
                cells = _cells(h, size)
                told |= np.logical_and.reduce([once[c] for c in cells])
                for c in cells:
                    once[c] = True
                    twice[c[told]] = True
        yield from full()

    return run


_ASKED = "bucket int, phase int, a long, b long, docs array<long>, bits binary"


def _ask(buckets: int, length: int, size: Size = Size()):
    """Digests of one document of a flush are questions to their bucket (phase 1). Those of several
    are known to repeat: they go to any bucket and pass through it (phase 2)."""

    def run(batches):
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId() * 7919
        for h, start, docs in _flushes(batches, length, size.flush):
            known = np.diff(start) > 1
            turn += 1
            anywhere = (np.arange(len(h)) + turn) % buckets
            bucket = np.where(known, anywhere, (h[:, 0] % _U(buckets)).astype(np.int64)).astype(np.int32)
            for at in range(0, len(h), 10_000):
                s = slice(at, min(at + 10_000, len(h)))
                offsets = start[s.start : s.stop + 1]
                held = pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(docs[offsets[0] : offsets[-1]]))
                half = h[s].view(np.int64)
                n = s.stop - s.start
                yield pa.RecordBatch.from_arrays([pa.array(bucket[s]), pa.array(np.where(known[s], 2, 1).astype(np.int32)), pa.array(half[:, 0].copy()), pa.array(half[:, 1].copy()), held, pa.nulls(n, pa.binary())], names=["bucket", "phase", "a", "b", "docs", "bits"])

    return run


def _suspects(size: Size):
    """Rows that the second filter of their bucket suspects; sorted by bucket and phase, the filter comes first."""

    def run(batches):
        now, twice = None, None
        for batch in batches:
            bucket, phase = np.asarray(batch.column("bucket")), np.asarray(batch.column("phase"))
            half = np.asarray(pc.fill_null(batch.column("b"), 0)).view(_U)
            good = phase == 2
            for value, at, to in _runs(bucket):
                if value != now:
                    now, twice = value, None
                if phase[at] == 0:
                    twice = np.unpackbits(np.frombuffer(zlib.decompress(batch.column("bits")[at].as_py()), dtype=np.uint8)).view(bool)
                if twice is not None:
                    good[at:to] |= (phase[at:to] == 1) & np.logical_and.reduce([twice[c] for c in _cells(half[at:to], size)])
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(np.flatnonzero(good))) for c in ("a", "b", "docs")], names=["a", "b", "docs"])

    return run


def repeated(docs: DataFrame, least: int = 3, length: int = 20, size: Size = Size()) -> DataFrame:
    """The lines to drop: doc_id (NO_ID for null), and the digests of its keys that at least `least` documents hold
    and a larger doc_id keeps. docs: doc_id and text."""
    bounded_batches(docs.sparkSession, rows=10_000)
    buckets = parts(text_bytes(docs), size.bucket)
    told = docs.mapInArrow(_tell(buckets, length, size), "bucket int, half long, several boolean")
    filters = told.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_filters(size), "bucket int, bits binary")
    asked = docs.mapInArrow(_ask(buckets, length, size), _ASKED)
    first = filters.select("bucket", F.lit(0).alias("phase"), *[F.lit(None).cast(kind).alias(c) for c, kind in (("a", "long"), ("b", "long"), ("docs", "array<long>"))], "bits")
    met = asked.unionByName(first).repartition("bucket").sortWithinPartitions("bucket", "phase")
    suspects = materialize(met.mapInArrow(_suspects(size), "a long, b long, docs array<long>"))
    # a row's documents are distinct and ascending: `least` of the largest suffice for the count and the largest of all
    few = suspects.select("a", "b", F.explode(F.slice("docs", F.greatest(F.size("docs") - (least - 1), F.lit(1)), least)).alias("doc"))
    sure = few.groupBy("a", "b").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("keeper")).where(F.col("n") >= least).drop("n")
    gone = suspects.join(sure, ["a", "b"]).select(F.explode("docs").alias("doc"), "a", "b", "keeper").where("doc <> keeper")
    return gone.groupBy("doc").agg(F.collect_set(F.struct("a", "b")).alias("gone"))


def _drop(length: int):
    def run(batches):
        for batch in batches:
            rows, texts, gone = batch.column("_row"), batch.column("_text"), batch.column("_gone")
            lines = np.asarray(pc.fill_null(pc.count_substring(pc.fill_null(texts, ""), "\n"), 0), dtype=np.int64) + 1
            new, dropped = texts.to_pylist(), np.zeros(len(texts), dtype=np.int64)
            for i in np.flatnonzero(np.asarray(pc.is_valid(gone).to_numpy(zero_copy_only=False))):
                bad = gone[i].values
                bad = {(a, b) for a, b in zip(bad.field("a").to_pylist(), bad.field("b").to_pylist(), strict=True)}
                _, own = cut(texts.slice(i, 1))
                place, h = digests(own, length)
                out = {p for p, x in zip(place.tolist(), map(tuple, h.view(np.int64).tolist()), strict=True) if x in bad}
                if out:
                    new[i] = "\n".join(x for k, x in enumerate(own.to_pylist()) if k not in out)
                    dropped[i] = len(out)
            yield pa.RecordBatch.from_arrays([rows, pa.array(new, pa.string()), pa.array(lines), pa.array(dropped)], names=["_row", "_text", "_lines", "_dropped"])

    return run


def _run(docs: DataFrame, row, key, text, least: int, length: int, size: Size) -> DataFrame:
    """_row, _text (what stays), _lines (before) and _dropped of each row of docs."""
    own = docs.select(key.alias("doc_id"), text.alias("text"))
    gone = repeated(own, least, length, size)
    held = docs.select(row.alias("_row"), text.alias("_text"), F.coalesce(key, F.lit(NO_ID)).alias("doc")).join(gone, "doc", "left")
    held = held.select("_row", "_text", F.col("gone").alias("_gone"))
    return held.mapInArrow(_drop(length), f"_row {held.schema['_row'].dataType.simpleString()}, _text string, _lines long, _dropped long")


def report(docs: DataFrame, least: int = 3, length: int = 20, id_column: str = "doc_id", size: Size = Size()) -> DataFrame:
    """doc_id, n_lines (before dropping), n_dropped and text (the lines that stay; an empty text for null)."""
    key = docs[id_column].cast("long")
    out = _run(docs, key, key, docs["text"], least, length, size)
    return out.select(F.col("_row").alias("doc_id"), F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.coalesce("_text", F.lit("")).alias("text"))


def drop_lines(docs: DataFrame, least: int = 3, length: int = 20, id_column: str = "doc_id", size: Size = Size()) -> DataFrame:
    """docs without the repeated lines; n_chars, where there is such a column, is counted anew in
    texts that lose some. Null texts stay null."""
    columns = docs.columns
    out = _run(docs, F.struct(*[docs[f"`{c}`"].alias(f"c{k}") for k, c in enumerate(columns)]), docs[id_column].cast("long"), docs["text"], least, length, size)

    def column(k: int, c: str):
        if c == "text":
            return F.col("_text").alias(c)
        old = F.col(f"_row.c{k}")
        if c == "n_chars":
            old = F.when(F.col("_dropped") > 0, F.length("_text").cast(docs.schema[c].dataType)).otherwise(old)
        return old.alias(c)

    return out.select(*[column(k, c) for k, c in enumerate(columns)])
