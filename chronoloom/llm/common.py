"""Shared pieces of the corpus operators: vectorised word hashing over Arrow
batches, bounded blocks of documents, and tables written to the shared folder.
"""

from __future__ import annotations

import ctypes
import math
import re
import tempfile
import uuid
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of text that one vectorised step looks at (one longer text is a step of its own).
STEP_BYTES = 512 << 10
#: Bytes of text that one block of documents holds on average.
BLOCK_BYTES = 8 << 20

# freed memory goes back to the system instead of staying in each worker's pool
pa.set_memory_pool(pa.system_memory_pool())
_malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def give_back() -> None:
    """Hand back to the system what was freed here; the C library keeps it otherwise, and a
    worker lives on between tasks, beside the executor's other workers."""
    _malloc_trim(0)


def lean(run):
    """A function of batches after which its worker gives freed memory back."""

    @wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def separators(spec: str) -> np.ndarray:
    """Byte classes of the two word patterns: True for bytes inside a word.

    "space": `[^\\x20\\x09-\\x0D]+`; "alnum": `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`.
    Both patterns only exclude ASCII characters, so UTF-8 bytes decide alone.
    """
    inside = np.ones(256, dtype=bool)
    if spec == "space":
        inside[[0x20, *range(0x09, 0x0E)]] = False
    elif spec == "alnum":
        inside[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
    else:
        raise ValueError(spec)
    return inside


def ascii_lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


_LOWER = ascii_lower()
#: A random 64-bit value for each byte, fixed by its seed.
_BYTE = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_powers: dict[str, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    key = hex(int(base))
    if key not in _powers or len(_powers[key]) < n:
        size = max(n, 1 << 16)
        p = np.full(size, base, dtype=_U)
        p[0] = 1
        table = np.cumprod(p)
        if size > STEP_BYTES + (1 << 16):
            return table[:n]
        _powers[key] = table
    return _powers[key][:n]


def rolling(values: np.ndarray, width: int, base: np.uint64, inverse: np.uint64) -> np.ndarray:
    """Rabin-Karp hashes of all runs of `width` values, by prefix sums."""
    n = len(values)
    if n < width:
        return np.zeros(0, dtype=_U)
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum(values * powers(base, n), out=sums[1:])
    return (sums[width:] - sums[:-width]) * powers(inverse, n)[: n - width + 1]


class Words:
    """Words of a run of texts: doc (index of the text), start and end bytes, hash."""

    __slots__ = ("data", "offsets", "starts", "ends", "doc", "hash", "first", "count")

    def __init__(self, texts: pa.Array, spec: str, lower: bool):
        texts = pc.fill_null(texts, "")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=kind, count=texts.offset + n + 1)[texts.offset :].astype(np.int64) if n else np.zeros(1, dtype=np.int64)
        body = texts.buffers()[2]
        data = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body is not None and n else np.zeros(0, dtype=np.uint8)
        offsets = offsets - offsets[0]
        inside = separators(spec)[_LOWER[data] if lower else data]
        size = len(data)
        before = np.zeros(size, dtype=bool)
        before[1:] = inside[:-1]
        before[offsets[:-1][offsets[:-1] < size]] = False
        after = np.zeros(size, dtype=bool)
        after[:-1] = inside[1:]
        last = offsets[1:][offsets[1:] > 0] - 1
        after[last] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.data, self.offsets = data, offsets
        self.doc = np.searchsorted(offsets, self.starts, side="right") - 1
        self.count = np.bincount(self.doc, minlength=n).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        sums = np.zeros(size + 1, dtype=_U)
        np.cumsum(_BYTE[_LOWER[data] if lower else data] * powers(_BASE, size), out=sums[1:])
        raw = (sums[self.ends] - sums[self.starts]) * powers(_BASE_INV, size)[self.starts]
        self.hash = mix(raw + (self.ends - self.starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def steps(texts: pa.Array, limit: int = STEP_BYTES):
    """(from, to) runs of rows with at most `limit` bytes of text, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    at, n = 0, len(sizes)
    total = np.cumsum(sizes)
    while at < n:
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield at, to
        at = to


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a temporary one, if driver
    and executors are one process (tests); on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="chronoloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: a cut of lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chronoloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what `materialize` wrote for these frames, once all that is read from them is written itself."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def join_by_weight(left: DataFrame, right: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """left with right's one row for each key, whose column `weight` is the number of left's rows
    that have it (of `total`). Keys with a thousandth of all rows or more are at most 1,000 and are
    broadcast, so that no hot key meets in one task; the others are merged."""
    hot, cold = right.where(F.col("weight") * 1000 >= total), right.where(F.col("weight") * 1000 < total).drop("weight")
    marked = left.join(F.broadcast(hot), key, "left")
    rest = marked.where("weight is null").select(*left.columns).join(cold.hint("merge"), key, how)
    return marked.where("weight is not null").drop("weight").unionByName(rest)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text))).alias("b")).first()[0] or 0


def parts(total_bytes: int, each: int) -> int:
    """How many parts of about `each` bytes the input makes."""
    return max(1, math.ceil(total_bytes / each))


def spread(docs: DataFrame, blocks: int, *keys: str) -> DataFrame:
    """docs with a column _block in 0 .. blocks - 1, dealt by a hash of the keys and
    shuffled once by it (equal plans share the exchange)."""
    return docs.withColumn("_block", F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int")).repartition(max(blocks, 1), "_block")


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Keep Arrow batches small in this session: one holds `rows` rows and `size` bytes at most,
    so that long texts and large binary values can't fill a worker."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name)
        if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= most:
            spark.conf.set(name, str(most))


def blob(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()
