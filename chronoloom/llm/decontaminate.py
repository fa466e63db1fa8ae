"""Benchmark decontamination by an FM-index for each shard of training texts.

A shard is a run of documents of a map task. Its words become symbols of the
benchmark's vocabulary; a word outside it can be part of no match, so it only
separates, and stretches shorter than the shortest window fall away (that is
lossless). The rest is indexed: windows are found by backward search through a
wavelet matrix's ranks, their places by sampled suffix positions, and the words
they cover merge into removal spans.

The benchmark is the stated query set. It is handled in blocks of bounded size
(`BENCHMARK_BYTES`, and at least one item); every block goes over all documents.

Defined results: null or empty texts have no words and no hits; items without
words (null text included) and items of null item_id have no window; repeated
item_ids count as one item; documents that repeat, doc_id included, are separate
rows; further columns are ignored by `find` and kept by `clean`; an empty
benchmark hits nothing; empty documents give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Words, bounded_batches, lean, materialize, steps
from .fm_index import FMIndex

#: Bytes of benchmark text in one block, apart from a single longer item.
BENCHMARK_BYTES = 4 << 20

_FOUND = "_row struct<{row}>, _text string, n_words long, hits array<array<int>>, items array<string>"


class _Queries:
    """Windows of one block of benchmark items as symbols of their vocabulary."""

    def __init__(self, ids: list, texts: list, width: int):
        words = Words(pa.array(texts, pa.string()), "alnum", lower=True)
        self.vocabulary = np.unique(words.hash)
        symbol = np.searchsorted(self.vocabulary, words.hash) + 1
        self.ids = np.array([str(x) for x in ids], dtype=object)
        rows: dict[int, list] = {}
        for k in range(len(ids)):
            own = symbol[words.first[k] : words.first[k + 1]]
            size = min(width, len(own))
            if size and ids[k] is not None:
                windows = np.lib.stride_tricks.sliding_window_view(own, size)
                rows.setdefault(size, []).append((windows, np.full(len(windows), k)))
        #: by window length: (distinct windows, window of each use, item of each use)
        self.windows = {}
        for size, found in rows.items():
            every, item = np.concatenate([w for w, _ in found]), np.concatenate([k for _, k in found])
            distinct, use = np.unique(every, axis=0, return_inverse=True)
            self.windows[size] = (distinct.astype(np.int64), use.ravel(), item)
        self.shortest = min(self.windows, default=0)

    def hits(self, words: Words):
        """(first word, length) of each occurrence of a window, and the distinct (document, item) of all."""
        none = np.zeros((0, 2), dtype=np.int64), np.zeros((0, 2), dtype=np.int64)
        n = len(words.hash)
        if not self.windows or not n:
            return none
        symbol = np.minimum(np.searchsorted(self.vocabulary, words.hash), len(self.vocabulary) - 1)
        known = self.vocabulary[symbol] == words.hash
        symbol += 1
        start = known.copy()
        start[1:] &= ~known[:-1] | (words.doc[1:] != words.doc[:-1])
        run = np.cumsum(start)
        length = np.bincount(run[known], minlength=int(run[-1]) + 1)
        use = np.flatnonzero(known & (length[run] >= self.shortest))
        if not len(use):
            return none
        # stretches, each followed by a separator: the largest symbol
        part = np.concatenate([[0], np.cumsum(run[use][1:] != run[use][:-1])])
        text = np.full(len(use) + int(part[-1]) + 1, len(self.vocabulary) + 1, dtype=np.int64)
        word = np.zeros(len(text), dtype=np.int64)
        place = np.arange(len(use)) + part
        text[place], word[place] = symbol[use], use
        index = FMIndex(text, len(self.vocabulary) + 2)
        out, pairs = [none[0]], [none[1]]
        for size, (distinct, window, item) in self.windows.items():
            lo, hi = index.search(distinct)
            some = np.flatnonzero(hi > lo)
            count = (hi - lo)[some]
            first = np.repeat(lo[some] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            at = word[index.locate(first)]
            found = np.repeat(some, count)
            out.append(np.stack([at, np.full(len(at), size)], axis=1))
            # a document's window counts once, however often it occurs, for each item that has it
            doc, found = np.unique(np.stack([words.doc[at], found]), axis=1)
            order = np.argsort(window, kind="stable")
            begin = np.searchsorted(window[order], np.arange(len(distinct) + 1))
            times = (begin[1:] - begin[:-1])[found]
            pick = np.repeat(begin[found] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
            pairs.append(np.unique(np.stack([np.repeat(doc, times), item[order][pick]], axis=1), axis=0))
        return np.concatenate(out), np.unique(np.concatenate(pairs), axis=0)


def _merged(hits: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, hits[:, 0], 1)
    np.add.at(edge, hits[:, 0] + hits[:, 1], -1)
    return np.cumsum(edge)[:-1] > 0


def _pass(queries):
    """Adds one benchmark block's hits to (_row, _text, n_words, hits, items)."""

    def run(batches):
        q = queries.value
        for batch in batches:
            for at, to in steps(batch.column(1)):
                words = Words(batch.column(1).slice(at, to - at), "alnum", lower=True)
                found, pairs = q.hits(words)
                covered = _merged(found, len(words.hash))
                spans, items = batch.column(3).slice(at, to - at).to_pylist(), batch.column(4).slice(at, to - at).to_pylist()
                for k in np.unique(pairs[:, 0]):
                    own = covered[words.first[k] : words.first[k + 1]]
                    edge = np.diff(np.concatenate([[0], own.view(np.int8), [0]]))
                    spans[k] += np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1).tolist()
                    items[k] += list(q.ids[pairs[pairs[:, 0] == k, 1]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), pa.array(words.count), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(items, pa.list_(pa.string()))],
                    names=["_row", "_text", "n_words", "hits", "items"],
                )

    return run


def _blocks(benchmark: DataFrame, limit: int):
    """The benchmark's (item_id, text) rows in blocks of bounded bytes, one at a time at the driver."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col("item_id").alias("i"), F.col("text").alias("t")).where("i is not null and t is not null").toLocalIterator():
        if ids and size + len(row.t) > limit:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row.i)
        texts.append(row.t)
        size += len(row.t)
    yield ids, texts


def _scan(docs: DataFrame, row: list, benchmark: DataFrame, width: int, limit: int) -> DataFrame:
    """_row (the named columns), n_words, spans (maximal hit word intervals), n_hit, item_ids."""
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    frame = docs.select(F.struct(*row).alias("_row"), docs["text"].alias("_text"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<array<int>>").alias("hits"), F.array().cast("array<string>").alias("items"))
    schema = frame.schema
    for k, (ids, texts) in enumerate(_blocks(benchmark, limit)):
        frame = (materialize(frame) if k else frame).mapInArrow(lean(_pass(spark.sparkContext.broadcast(_Queries(ids, texts, width)))), schema)
    # spans of several blocks may meet: merged from left to right
    merged = F.expr(
        "aggregate(array_sort(hits), cast(array() as array<array<int>>), (acc, x) -> if(size(acc) > 0 and element_at(acc, -1)[1] >= x[0],"
        " concat(slice(acc, 1, size(acc) - 1), array(array(element_at(acc, -1)[0], greatest(element_at(acc, -1)[1], x[1])))), concat(acc, array(x))))"
    )
    spans = frame.select("_row", "n_words", merged.alias("spans"), F.array_sort(F.array_distinct("items")).alias("item_ids"))
    return spans.withColumn("n_hit", F.expr("aggregate(spans, 0L, (n, x) -> n + x[1] - x[0])"))


def find(docs: DataFrame, benchmark: DataFrame, width: int = 13, limit: int = BENCHMARK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, spans, item_ids (sorted), contaminated
    (n_hit > 0 and 20 * n_hit >= n_words)."""
    found = _scan(docs, [docs["doc_id"].cast("long").alias("doc_id")], benchmark, width, limit)
    return found.select("_row.doc_id", "n_words", "n_hit", "spans", "item_ids", F.expr("n_hit > 0 and 20 * n_hit >= n_words").alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 13, limit: int = BENCHMARK_BYTES) -> DataFrame:
    """docs without the contaminated documents; the others stay as they are."""
    found = _scan(docs, [docs[f"`{c}`"] for c in docs.columns], benchmark, width, limit)
    return found.where("not (n_hit > 0 and 20 * n_hit >= n_words)").select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
