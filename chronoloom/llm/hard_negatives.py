"""Hard negatives for anchors, searched through buckets of equal norm.

Candidates are sorted by norm and written in buckets; a run of buckets is a slab. An anchor
block meets slab after slab, and within a slab bucket after bucket, largest norms first. By
Cauchy-Schwarz no product in a bucket exceeds the anchor's norm times the bucket's largest norm. A bucket is
left out for an anchor if that bound lies below every window's lower limit, or below the running
k-th score of every window that is full; whole slabs go by the same bound before anything is shipped. What is
left is multiplied as matrices.

Two rounds of that search: the first finds each anchor's positives (other rows of its label), the second,
for each of them, the rows of other labels whose score lies in its window. Scores are integers: components
are floor(256 * x). Products whose bound leaves the exact range of doubles are computed with whole numbers
of any size; a score beyond a long is given as the nearest long.

A task holds an anchor block and a slab. The anchors are a stated set against all rows, in blocks.

Defined results: rows with a null vec_id, label or vector, or a null or non-finite component, take no
part; vectors of other lengths than the anchor's are no candidates (an empty vector has score 0 with
empty ones); an anchor vec_id that repeats is one anchor (its least label and vector), and no row of its vec_id is its positive; repeated
candidate rows each count; ties go to the smaller vec_id; a positive whose score is negative has no window;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.ranks import ranked
from .common import bounded_batches, materialize

SCALE = 256
#: Rows of an anchor block, of a bucket and of a slab; anchors multiplied at once.
ANCHORS, BUCKET, SLAB, STRIP = 2048, 512, 8192, 256
#: Tasks of one round; more pairs of a block and a slab share them.
MOST_TASKS = 20_000
#: Products up to this are exact in doubles, whatever the order of the sum.
EXACT = 2.0**52
_LONG = (1 << 63) - 1
_LARGEST = "1.7976931348623157e308"


def usable(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, v (integers as doubles), d (their number) and norm of the rows that take part."""
    own = vectors.select(vectors[id_column].cast("long").alias("vec_id"), vectors[label].cast("long").alias("label"), vectors[column].cast("array<double>").alias("x"))
    good = own.where(f"vec_id is not null and label is not null and x is not null and forall(x, y -> y is not null and abs(y) <= {_LARGEST}D)")
    whole = good.select("vec_id", "label", F.transform("x", _whole).alias("v"))
    return whole.withColumns({"d": F.size("v"), "norm": F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, y: a + y * y))})


def _whole(x: Column) -> Column:
    """floor(256 * x) as a double. From 2 ** 52 on doubles are whole; what passes the largest one stays that."""
    y = x * SCALE
    return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(F.least(F.greatest(y, F.lit(-float(_LARGEST))), F.lit(float(_LARGEST))))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), d)


def products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Integer inner products of all rows as longs; where doubles could round, by whole numbers of any size."""
    if bound < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(a).dot(whole(b).T), -_LONG - 1, _LONG).astype(np.int64)


def _best(score: np.ndarray, good: np.ndarray, ids: np.ndarray, k: int):
    """(row, column) of each row's k largest scores that are good, ties to the smaller id."""
    row, col = np.nonzero(good)
    value = score[row, col]
    order = np.lexsort((ids[col], ~value, row))  # ~ turns the order of all longs
    row, col = row[order], col[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], col[first]


class Running:
    """The k best (score, vec_id) of each window so far. low and high: limits of the windows as whole numbers
    (100 * score lies in them), or None for no limits."""

    def __init__(self, n: int, k: int, low=None, high=None):
        self.n, self.k, self.low, self.high = n, k, low, high
        self.window, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.score = np.zeros(0, dtype=np.int64)
        self.kth = np.full(n, -np.inf)

    def add(self, window: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.window, self.ids = np.concatenate([self.window, window]), np.concatenate([self.ids, ids])
        self.score = np.concatenate([self.score, score])
        order = np.lexsort((self.ids, ~self.score, self.window))
        order = order[np.arange(len(order)) - np.searchsorted(self.window[order], self.window[order]) < self.k]
        self.window, self.ids, self.score = self.window[order], self.ids[order], self.score[order]
        full = np.flatnonzero(np.bincount(self.window, minlength=self.n) == self.k)
        self.kth[full] = self.score[np.searchsorted(self.window, full, side="right") - 1].astype(np.float64)


def search(norms, vectors, labels, ids, windows: Running, owner, buckets, same: bool) -> int:
    """Fill the windows (owner: each one's anchor) from buckets of (largest norm, ids, labels, vectors) in falling order
    of norm. same: candidates of the anchor's label but not of its id, else those of other labels. The number of products."""
    work = 0
    low = np.full(windows.n, -np.inf) if windows.low is None else np.array([float(x) / 100 for x in windows.low])
    for top, cids, clabels, cvectors in buckets:
        bound = np.nan_to_num(norms[owner] * top * (1 + 1e-9), nan=np.inf, posinf=np.inf)
        open_ = (bound >= low - 1e-9 * np.abs(low)) & ~(bound < windows.kth * (1 - 1e-9))
        if not open_.any():
            continue
        live = np.flatnonzero(open_)
        for at in range(0, len(live), STRIP):
            w = live[at : at + STRIP]
            rows, inverse = np.unique(owner[w], return_inverse=True)
            score = products(vectors[rows], cvectors, float(norms[rows].max(initial=0)) * top)[inverse]
            work += len(rows) * len(cids)
            equal = labels[owner[w], None] == clabels[None, :]
            good = equal & (ids[owner[w], None] != cids[None, :]) if same else ~equal
            if windows.low is not None:
                large = max(score.max(initial=0), -(score.min(initial=0) + 1)) >= 2**55
                hundred = (score.astype(object) if large else score) * 100
                good &= (hundred >= windows.low[w, None]).astype(bool) & (hundred <= windows.high[w, None]).astype(bool)
            row, col = _best(score, good, cids, windows.k)
            windows.add(w[row], score[row, col], cids[col])
    return work


def _buckets(table: pa.Table, d: int):
    """Buckets of a slab in falling order of norm."""
    order = np.argsort(-np.asarray(table.column("norm")), kind="stable")
    table = table.take(pa.array(order))
    for at in range(0, table.num_rows, BUCKET):
        part = table.slice(at, BUCKET)
        norm = np.asarray(part.column("norm"))
        yield norm[0], np.asarray(part.column("vec_id")), np.asarray(part.column("label")), _matrix(part.column("v"), d)


_FOUND = "anchor long, place int, found long, score long"


def _meeting(k: int, same: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"anchor": pa.array([], pa.int64()), "place": pa.array([], pa.int32()), "found": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        d = left.column("d")[0].as_py()
        ids, labels, norms = (np.asarray(left.column(c)) for c in ("vec_id", "label", "norm"))
        vectors = _matrix(left.column("v"), d)
        if same:
            owner, place, windows = np.arange(len(ids)), np.zeros(len(ids), dtype=np.int32), Running(len(ids), k)
        else:
            scores = left.column("scores").combine_chunks()
            owner = np.repeat(np.arange(len(ids)), np.diff(np.asarray(scores.offsets)))
            flat = np.asarray(scores.flatten())
            place = (np.arange(len(owner)) - np.searchsorted(owner, owner) + 1).astype(np.int32)
            whole = flat if flat.max(initial=0) < 2**55 else flat.astype(object)
            windows = Running(len(owner), k, whole * 80, whole * 100)
        search(norms, vectors, labels, ids, windows, owner, _buckets(right, d), same)
        return pa.table({"anchor": pa.array(ids[owner[windows.window]]), "place": pa.array(place[windows.window]), "found": pa.array(windows.ids), "score": pa.array(windows.score)})

    return run


def _round(anchors: DataFrame, slabs: DataFrame, sizes: DataFrame, k: int, same: bool) -> DataFrame:
    """The k best of each anchor's windows over all slabs, with their order as rank. anchors has need: the least
    largest norm of a slab that can hold anything for it."""
    # anchors of like needs share a block, so that a slab is open for all of them or for none
    dealt = ranked(anchors, "need", "vec_id").withColumn("block", F.floor((F.col("rank") - 1) / ANCHORS)).drop("rank")
    least = dealt.groupBy("d", "block").agg(F.min("need").alias("least"))
    # numbers of blocks and slabs only: which pairs meet at all
    pairs = least.join(sizes, "d").where(F.col("top") * (1 + 1e-9) >= F.col("least")).select("d", "block", "slab")
    n = min(max(1, pairs.count()), MOST_TASKS)
    keys = ["d", "block", "slab"]
    left = dealt.join(pairs.toDF(*keys), ["d", "block"]).repartition(n, *keys)
    right = slabs.join(pairs.toDF(*keys), ["d", "slab"]).repartition(n, *keys)
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_meeting(k, same), _FOUND)
    w = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "found")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, id_column: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its
    first `positives` rows of the same label, the first `negatives` rows of other labels that score between 80 % of
    the positive's score and all of it."""
    bounded_batches(vectors.sparkSession, rows=10_000)
    every = usable(vectors, id_column, column, label)
    slabs = ranked(every, F.desc("norm"), "vec_id").withColumn("slab", F.floor((F.col("rank") - 1) / SLAB)).drop("rank")
    sizes = slabs.groupBy("d", "slab").agg(F.max("norm").alias("top"))
    asked = usable(anchors, id_column, column, label).groupBy("vec_id").agg(F.min(F.struct("label", "v", "d", "norm")).alias("r")).select("vec_id", "r.*")
    near = materialize(_round(asked.withColumn("need", F.lit(0.0)), slabs, sizes, positives, True))
    # a window needs a slab whose largest norm times the anchor's reaches its lower limit
    own = near.where("score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("found").alias("positive"), "score"))).alias("p"))
    hunters = asked.join(own.withColumnRenamed("anchor", "vec_id"), "vec_id").withColumn("scores", F.col("p.score"))
    low = F.array_min("scores") * 0.8
    hunters = hunters.withColumn("need", F.when(F.col("norm") > 0, low / F.col("norm")).otherwise(0.0)).select("vec_id", "label", "v", "d", "norm", "scores", "need")
    found = _round(hunters, slabs, sizes, negatives, False)
    pairs = own.select("anchor", F.posexplode("p").alias("at", "x")).select("anchor", (F.col("at") + 1).alias("place"), F.col("x.positive").alias("positive"), F.col("x.score").alias("positive_score"))
    return found.join(pairs, ["anchor", "place"]).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
