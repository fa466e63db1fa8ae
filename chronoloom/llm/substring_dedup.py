"""Substring dedup: Rabin-Karp hashes of every window of `width` words, counted
across the corpus; repeated windows merge into maximal removal intervals.

Two shuffles carry hashes, not words. A block of documents deals its distinct
window hashes out over buckets; a bucket counts in how many places each occurs
and answers every block with one bit for each hash it sent. So a passage that a
third of all documents share costs a bucket one entry for each block.

A window is identified by the 64 bits sent plus the bucket, which comes from a
second polynomial: the chance of a false match stays the same at every size,
since buckets grow in number and not in length.

Defined results: a null or empty text has no words; a text of fewer words than
`width` has no window and loses nothing; rows that repeat, doc_id included, are
separate documents and so repeat each other's windows; further columns pass
through `dedup_texts` untouched and are ignored by `removals`; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from .common import BLOCK_BYTES, Words, blob, bounded_batches, give_back, mix, parts, rolling, spread, steps, text_bytes

_U = np.uint64
_B1, _B2 = 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
_BASES = [(_U(b), _U(pow(b, -1, 1 << 64))) for b in (_B1, _B2)]


def _windows(texts: pa.Array, width: int, buckets: int):
    """For each step: (from, to, Words, index of each window's first word, its hash, its bucket)."""
    for at, to in steps(texts):
        words = Words(texts.slice(at, to - at), "space", lower=False)
        if len(words.hash) < width:
            none = np.zeros(0, dtype=np.int64)
            yield at, to, words, none, none.astype(_U), none.astype(np.int32)
            continue
        one, two = (rolling(words.hash, width, *b) for b in _BASES)
        whole = words.doc[: len(one)] == words.doc[width - 1 :]
        index = np.flatnonzero(whole)
        yield at, to, words, index, mix(one[index]), (mix(two[index]) % _U(buckets)).astype(np.int32)


def _block_hashes(texts: pa.Array, width: int, buckets: int):
    """The distinct (bucket, hash) entries in order, and each window's entry. A block has a million
    windows or more, so nothing is held longer than it is needed."""
    found = [(h, b) for *_, h, b in _windows(texts, width, buckets)]
    h = np.concatenate([h for h, _ in found]) if found else np.zeros(0, dtype=_U)
    b = np.concatenate([b for _, b in found]) if found else np.zeros(0, dtype=np.int32)
    del found
    order = np.lexsort((h, b)) if len(h) else np.zeros(0, dtype=np.int64)
    h = h[order]
    b = b[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (b[1:] != b[:-1])
    entry = np.empty(len(h), dtype=np.int32)
    entry[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return h[new], b[new], entry


def _questions(width: int, buckets: int):
    def ask(table: pa.Table) -> pa.Table:
        block = table.column("_block")[0].as_py() if table.num_rows else 0
        h, b, entry = _block_hashes(table.column("text").combine_chunks(), width, buckets)
        twice = np.bincount(entry, minlength=len(h)) > 1
        del entry
        cut = np.searchsorted(b, np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(cut))
        del b
        give_back()
        return pa.table({
            "_block": pa.array(np.full(len(some), block, dtype=np.int32)),
            "bucket": pa.array(some.astype(np.int32)),
            "hashes": pa.array([blob(h[cut[k] : cut[k + 1]]) for k in some], pa.binary()),
            "twice": pa.array([blob(np.packbits(twice[cut[k] : cut[k + 1]])) for k in some], pa.binary()),
        })

    return ask


def _answers(table: pa.Table) -> pa.Table:
    hashes = [np.frombuffer(x.as_buffer(), dtype=_U) for x in table.column("hashes")]
    sizes = [len(h) for h in hashes]
    every = np.concatenate(hashes)
    twice = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), dtype=np.uint8), count=n).astype(bool) for x, n in zip(table.column("twice"), sizes, strict=True)])
    order = np.argsort(every)
    h = every[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    entry = np.cumsum(new) - 1
    hot = (np.bincount(entry) > 1) | (np.bincount(entry, weights=twice[order]) > 0)
    repeated = np.empty(len(h), dtype=bool)
    repeated[order] = hot[entry]
    ends = np.cumsum(sizes)
    del every, order, h, new, entry, hot
    give_back()
    return pa.table({
        "_block": table.column("_block"),
        "bucket": table.column("bucket"),
        "bits": pa.array([blob(np.packbits(repeated[e - n : e])) for e, n in zip(ends, sizes, strict=True)], pa.binary()),
    })


def _covered(table: pa.Table, answers: pa.Table, width: int, buckets: int):
    """For each document of the block: number of words and a mask of the removed ones."""
    texts = table.column("text").combine_chunks()
    h, b, entry = _block_hashes(texts, width, buckets)
    cut = np.searchsorted(b, np.arange(buckets + 1))
    repeated = np.zeros(len(h), dtype=bool)
    for k, bits in zip(answers.column("bucket").to_pylist(), answers.column("bits"), strict=True):
        n = cut[k + 1] - cut[k]
        repeated[cut[k] : cut[k + 1]] = np.unpackbits(np.frombuffer(bits.as_buffer(), dtype=np.uint8), count=n)
    del h, b
    give_back()
    seen = 0
    for at, to, words, index, _, _ in _windows(texts, width, buckets):
        hit = index[repeated[entry[seen : seen + len(index)]]]
        seen += len(index)
        edge = np.zeros(len(words.hash) + 1, dtype=np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, np.minimum(hit + width, len(words.hash)), -1)
        gone = np.cumsum(edge)[:-1] > 0
        for k in range(to - at):
            yield at + k, gone[words.first[k] : words.first[k + 1]]


def _spans(mask: np.ndarray) -> list[list[int]]:
    """Maximal [from, to) runs of removed words."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1).tolist()


def _run(docs: DataFrame, keep: list[str], width: int, emit, schema) -> DataFrame:
    """docs: id column, text and `keep`; emit(table, rows) makes the result of one block."""
    bounded_batches(docs.sparkSession)
    total = text_bytes(docs)
    blocks, buckets = parts(total, BLOCK_BYTES), parts(total, BLOCK_BYTES)
    dealt = spread(docs, blocks, *keep, "text")  # rows of one id with other texts go apart
    ask = dealt.groupBy("_block").applyInArrow(_questions(width, buckets), "_block int, bucket int, hashes binary, twice binary")
    answer = ask.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_answers, "_block int, bucket int, bits binary")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = emit(left, _covered(left, right, width, buckets))
        give_back()
        return out

    return dealt.groupBy("_block").cogroup(answer.repartition(blocks, "_block").groupBy("_block")).applyInArrow(finish, schema)


def removals(docs: DataFrame, width: int = 50, id_column: str = "doc_id") -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, spans (maximal removed
    word intervals [from, to))."""

    def emit(table: pa.Table, rows) -> pa.Table:
        texts = table.column("text").combine_chunks()
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "spans": []}
        for i, gone in rows:
            words = (texts[i].as_py() or "").encode().split()
            kept = b" ".join(compress(words, (~gone).tolist()) if gone.any() else words)
            out["n_words"].append(len(words))
            out["n_removed"].append(int(gone.sum()))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["spans"].append(_spans(gone))
        return pa.table({
            "doc_id": table.column("doc_id"),
            "n_words": pa.array(out["n_words"], pa.int64()),
            "n_removed": pa.array(out["n_removed"], pa.int64()),
            "kept_sha256": pa.array(out["kept_sha256"], pa.string()),
            "spans": pa.array(out["spans"], pa.list_(pa.list_(pa.int32()))),
        })

    source = docs.select(docs[id_column].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return _run(source, ["doc_id"], width, emit, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<array<int>>")


def dedup_texts(docs: DataFrame, width: int = 50) -> DataFrame:
    """docs with the repeated passages cut out of `text` (and n_chars, where there is
    such a column, counted anew). A text that loses nothing stays as it is, white
    space included; of another, the kept stretches stay as they are and a cut
    leaves one line break. Null texts stay null."""
    columns = docs.columns
    others = [docs[f"`{c}`"] for c in columns if c != "text"]
    key = docs["doc_id"].cast("long") if "doc_id" in columns else F.xxhash64(docs["text"])
    source = docs.select(F.struct(*others).alias("_row") if others else F.lit(None).cast("int").alias("_row"), key.alias("_key"), docs["text"].alias("text"))

    def emit(table: pa.Table, rows) -> pa.Table:
        texts = table.column("text").combine_chunks()
        new, cut = texts.to_pylist(), [False] * len(texts)
        for i, gone in rows:
            if gone.any():
                one = Words(texts.slice(i, 1), "space", lower=False)
                raw = one.data.tobytes()
                new[i] = "\n".join(raw[one.starts[a] : one.ends[b - 1]].decode() for a, b in _spans(~gone))
                cut[i] = True
        return pa.table({"_row": table.column("_row"), "text": pa.array(new, pa.string()), "_cut": pa.array(cut, pa.bool_())})

    out = _run(source, ["_key"], width, emit, StructType([source.schema["_row"], StructField("text", StringType()), StructField("_cut", BooleanType())]))
    count = F.when(F.col("_cut"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars")) if "n_chars" in columns else None
    return out.select(*[F.col("text") if c == "text" else count.alias(c) if c == "n_chars" else F.col(f"_row.`{c}`").alias(c) for c in columns])
