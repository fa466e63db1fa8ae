"""Importance resampling towards a target: documents whose word runs look like the target's are drawn.

Every run of one to three words falls into one of `buckets` by the CRC-32 of its bytes. The sparse matrix of
documents by buckets is written once as blocks of compressed sparse rows; sums of its columns are the
distribution of the corpus, those of the target's matrix the target's, and the product of the matrix with the
buckets' gains (logarithms of the ratio, in thousandths) is each document's weight. Noise from a hash of the
document's number turns weights into a draw without replacement: the largest scores are drawn.

A run's CRC comes from those of its words: the CRC of a longer text is the shifted CRC of its beginning
xor the CRC of its end, so that bytes are looked at once. What is broadcast is one number for
each bucket. Places of the draw come from `operators.ranks`: no task sees all scores.

Defined results: a null or empty text has no runs and weight 0; runs don't cross documents; rows
that share a doc_id count each; a null doc_id is an empty text in the noise and comes last
among ties; with an empty corpus the result is empty, with an empty target all t are 0; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.ranks import ranked
from .common import Words, ascii_lower, blob, bounded_batches, materialize, steps

BUCKETS, LONGEST = 10_000, 3
#: Entries of a block of sparse rows; one document's more are a block of their own.
BLOCK_ENTRIES = 1 << 20
#: Words up to this many bytes are looked at together.
_SHORT = 32

_LOWER = ascii_lower()


def _bytewise(x: np.ndarray) -> np.ndarray:
    """A CRC register after one more zero byte."""
    return _CRC[x & 255] ^ (x >> np.uint32(8))


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table.astype(np.uint32)


_CRC = _crc_table()


def _shift_tables() -> np.ndarray:
    """[zero bytes][byte of the register][its value]: the register after so many zero bytes."""
    now = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    out = [now]
    for _ in range(64):
        out.append(now := _bytewise(now))
    return np.stack(out)


_SHIFT = _shift_tables()


def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & 255] ^ table[1][(x >> 8) & 255] ^ table[2][(x >> 16) & 255] ^ table[3][x >> 24]


def shift(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRCs moved `size` zero bytes on."""
    part, rest = size & 63, size >> 6
    t = _SHIFT
    x = t[part, 0, x & 255] ^ t[part, 1, (x >> 8) & 255] ^ t[part, 2, (x >> 16) & 255] ^ t[part, 3, x >> 24]
    power = _SHIFT[64]
    while rest.any():
        odd = np.flatnonzero(rest & 1)
        x[odd] = _apply(power, x[odd])
        rest, power = rest >> 1, _apply(power, power)
    return x


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """zlib.crc32 of each word."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    sizes, from_ = size[order], starts[order]
    out = np.full(len(size), 0xFFFFFFFF, dtype=np.uint32)
    long = int(np.searchsorted(-sizes, -_SHORT, side="left"))  # the first words are longer than that
    for k in range(min(int(sizes[long]), _SHORT) if long < len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -k, side="left"))  # words of more than k bytes
        out[long:n] = _CRC[(out[long:n] ^ data[from_[long:n] + k]) & 255] ^ (out[long:n] >> np.uint32(8))
    crc = np.empty(len(size), dtype=np.uint32)
    crc[order] = ~out
    for i in order[:long]:
        crc[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return crc


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text's index, CRC) of each run of one to three words joined by one space."""
    crc, size = word_crcs(_LOWER[words.data], words.starts, words.ends), words.ends - words.starts
    spaced = shift(np.full(len(crc), zlib.crc32(b" "), dtype=np.uint32), size) ^ crc
    docs, found, now = [words.doc], [crc], crc
    for run in range(1, LONGEST):
        now = shift(now[:-1], size[run:] + 1) ^ spaced[run:]
        inside = words.doc[run:] == words.doc[:-run] if len(now) else np.zeros(0, dtype=bool)
        docs.append(words.doc[run:][inside])
        found.append(now[inside])
    return np.concatenate(docs), np.concatenate(found)


def _packed(indices: np.ndarray, indptr: np.ndarray) -> bytes:
    """Sorted indices of rows as differences, low bytes before high ones."""
    gap = np.diff(indices, prepend=0)
    first = indptr[:-1][indptr[:-1] < indptr[1:]]
    gap[first] = indices[first]
    return blob(gap.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)


def _unpacked(data: pa.Scalar, indptr: np.ndarray) -> np.ndarray:
    gap = np.ascontiguousarray(np.frombuffer(data.as_buffer(), dtype=np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)
    total = np.cumsum(gap)
    before = np.where(indptr[:-1] > 0, total[np.maximum(indptr[:-1], 1) - 1], 0) if len(total) else np.zeros(len(indptr) - 1, dtype=np.int64)
    return total - np.repeat(before, np.diff(indptr))


_BLOCK = "ids array<long>, words array<long>, indptr binary, indices binary, counts binary"


def _blocks(buckets: int):
    def run(batches):
        ids, words, ends, indices, counts = [], [], [], [], []
        held = 0

        def out():
            indptr = np.concatenate([[0], np.cumsum(np.concatenate(ends))])
            row = [[x for part in ids for x in part], np.concatenate(words).tolist()], _packed(np.concatenate(indices), indptr), np.concatenate(counts).astype(np.uint32)
            codec = pa.Codec("zstd", 1)
            # the lengths of the plain bytes follow from indptr
            return pa.RecordBatch.from_arrays(
                [pa.array([row[0][0]], pa.list_(pa.int64())), pa.array([row[0][1]], pa.list_(pa.int64())), pa.array([blob(indptr.astype(np.int64))], pa.binary()),
                 pa.array([codec.compress(row[1], asbytes=True)], pa.binary()), pa.array([codec.compress(blob(row[2].view(np.uint8).reshape(-1, 4).T), asbytes=True)], pa.binary())],
                names=["ids", "words", "indptr", "indices", "counts"],
            )

        for batch in batches:
            texts, names = batch.column("text"), batch.column("id").to_pylist()
            for at, to in steps(texts):
                own = Words(texts.slice(at, to - at), "alnum", lower=True)
                doc, crc = features(own)
                key, n = np.unique(doc * buckets + crc % np.uint32(buckets), return_counts=True)
                ids.append(names[at:to])
                words.append(own.count)
                ends.append(np.bincount(key // buckets, minlength=to - at))
                indices.append(key % buckets)
                counts.append(n)
                held += len(key)
                if held >= BLOCK_ENTRIES:
                    yield out()
                    ids, words, ends, indices, counts = [], [], [], [], []
                    held = 0
        if ids:
            yield out()

    return run


def matrix(docs: DataFrame, id_column: str, buckets: int = BUCKETS) -> DataFrame:
    """The counts of docs as written blocks of sparse rows."""
    bounded_batches(docs.sparkSession)
    return materialize(docs.select(docs[id_column].cast("long").alias("id"), docs["text"].alias("text")).mapInArrow(_blocks(buckets), _BLOCK))


def _entries(batch: pa.RecordBatch):
    """(numbers, words, row limits, indices, counts) of each block."""
    codec = pa.Codec("zstd")
    for ids, words, limits, indices, counts in zip(*[batch.column(c) for c in ("ids", "words", "indptr", "indices", "counts")], strict=True):
        indptr = np.frombuffer(limits.as_buffer(), dtype=np.int64)
        n = 4 * int(indptr[-1])
        plain = [pa.scalar(codec.decompress(x.as_buffer(), n, asbytes=True), pa.binary()) for x in (indices, counts)]
        count = np.ascontiguousarray(np.frombuffer(plain[1].as_buffer(), dtype=np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
        yield ids.values, words.values, indptr, _unpacked(plain[0], indptr), count.astype(np.int64)


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how often each bucket occurs that does."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, _, indices, counts in _entries(batch):
                total += np.bincount(indices, weights=counts, minlength=buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return blocks.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the logarithm of the target's smoothed share over the corpus's: one for each bucket."""
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0).select("bucket", "s", "t").toPandas()  # a row for each bucket
    s, t = (np.zeros(buckets, dtype=np.int64) for _ in range(2))
    s[both["bucket"]], t[both["bucket"]] = both["s"], both["t"]
    S, T = int(s.sum()), int(t.sum())
    ratio = (t + 1).astype(np.float64) * float(S + buckets) / ((s + 1).astype(np.float64) * float(T + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the product of the matrix and the gains."""

    def run(batches):
        for batch in batches:
            for ids, words, indptr, indices, counts in _entries(batch):
                worth, number = (np.concatenate([[0], np.cumsum(x)]) for x in (gain[indices] * counts, counts))
                yield pa.RecordBatch.from_arrays([ids, words, pa.array(np.diff(number[indptr])), pa.array(np.diff(worth[indptr]))], names=["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def draw(docs: DataFrame, target: DataFrame, percent: int = 5, least: int = 20, seed: int = 42, buckets: int = BUCKETS, id_column: str = "doc_id", target_id: str = "item_id") -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) of every document; floor(percent/100) of
    the documents with `least` words are drawn."""
    blocks = matrix(docs, id_column, buckets)
    gain = gains(column_sums(blocks, buckets), column_sums(matrix(target, target_id, buckets), buckets), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = weights(blocks, gain).withColumn("score", F.col("weight") + noise)
    columns = ["doc_id", "n_features", "weight", "score"]
    placed = ranked(scored.where(F.col("n_words") >= least).select(*columns), F.desc("score"), F.asc_nulls_last("doc_id"))
    drawn = percent * placed.count() // 100
    rest = scored.where(F.col("n_words") < least).select(*columns, F.lit(None).cast("long").alias("rank"))
    return placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least: int = 20, seed: int = 42, id_column: str = "doc_id", target_id: str = "item_id") -> DataFrame:
    """The documents that are drawn (all rows of a drawn doc_id), with all their columns."""
    chosen = draw(docs, target, percent, least, seed, BUCKETS, id_column, target_id).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(chosen, docs[id_column].cast("long").eqNullSafe(F.col("_drawn")), "left_semi")
