"""Nearest neighbours by a block matrix join.

Vectors are dealt into blocks; each pair of a query block and a candidate block is
a tile. In a tile, int8 copies of the vectors are multiplied as matrices. With the
residual norms of the quantisation, Cauchy-Schwarz bounds how far each product can
be off; a candidate whose upper bound lies below the query's k-th best lower bound
cannot be among the tile's k best. The others are recomputed in double precision
from the original vectors, and the tiles' results are merged by a heap for each query.
The result is exact: recall is 1.

The queries are a stated set against all rows, in blocks: a task holds two blocks,
whatever the size of either side. A candidate block is sent once for each query block.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part; vectors of different lengths are searched apart; ties go to the smaller vec_id; fewer
candidates than k give as many rows; a repeated query vec_id is one query (its least
vector), repeated candidate rows each count; rows of null vec_id take no part; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, parts

#: Rows of a query block and of a candidate block, and query rows multiplied at once.
QUERIES, CANDIDATES, STRIP = 4096, 8192, 256


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1)


def _quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values (held as floats, so that the product runs as a matrix product; sums
    of up to 1,000 products are exact in single precision, longer ones in double),
    scale, norm of the quantised vector and norm of the residual."""
    scale = np.abs(v).max(axis=1) / 127.0
    q = np.rint(v / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    kind = np.float32 if v.shape[1] <= 1000 else np.float64
    return q.astype(kind), scale, np.linalg.norm(back, axis=1), np.linalg.norm(v - back, axis=1)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
    """(query id, vec_id, score) of each query's k best candidates of the tile."""
    a, sa, _, ea = _quantised(queries)
    b, sb, nb, eb = _quantised(vectors)
    na = np.linalg.norm(queries, axis=1)
    out = []
    for at in range(0, len(query_ids), STRIP):
        s = slice(at, at + STRIP)
        near = (a[s] @ b.T).astype(np.float64) * sa[s, None] * sb[None, :]
        # |xy - x'y'| <= |x| |y - y'| + |x - x'| |y'|, and a hair for the rounding of the sums
        off = (na[s, None] * eb[None, :] + ea[s, None] * nb[None, :]) * (1 + 1e-9) + 1e-12 * na[s, None] * (nb + eb)[None, :]
        own = query_ids[s, None] == ids[None, :]
        # bounds that overflow say nothing: such pairs bound no others and are all recomputed
        low = near - off
        low[own | ~np.isfinite(low)] = -np.inf
        cut = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] >= k else np.full(len(low), -np.inf)
        row, col = np.nonzero(~own & ~(near + off < cut[:, None]))
        score = _exact(queries[s][row], vectors[col])
        order = np.lexsort((ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append((query_ids[s][row[best]], ids[col[best]], score[best]))
    return (np.concatenate(x) for x in zip(*out, strict=True))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k candidates of the largest inner product for each query: query_id, rank, vec_id, score."""
    bounded_batches(vectors.sparkSession, rows=10_000)

    def usable(df: DataFrame) -> DataFrame:
        # numbers past the largest double are none here; a NaN compares as larger than all
        good = "vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and abs(x) <= 1.7976931348623157e308D) and exists(v, x -> x <> 0)"
        return df.select(df[id_column].cast("long").alias("vec_id"), df[column].cast("array<double>").alias("v")).where(good)

    every = usable(vectors)
    asked = usable(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    total = every.count()
    nq, nc = parts(asked.count(), QUERIES), parts(total, CANDIDATES)
    # vectors of different lengths are searched apart
    q = asked.withColumn("d", F.size("v")).withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(nq)).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
    # candidates are dealt by their whole row, so that a repeated vec_id fills no block
    c = every.withColumn("d", F.size("v")).withColumn("cb", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(nc)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            found = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        else:
            found = tile(np.asarray(left.column("vec_id")), _matrix(left.column("v")), np.asarray(right.column("vec_id")), _matrix(right.column("v")), k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found), strict=True)))

    def merge(batches):
        best: dict[int, list] = {}
        for batch in batches:
            for query, vec, value in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                heap = best.setdefault(query, [])
                if len(heap) < k:
                    heapq.heappush(heap, (value, -vec))
                else:
                    heapq.heappushpop(heap, (value, -vec))
        rows = [(query, r, -vec, value) for query, heap in best.items() for r, (value, vec) in enumerate(sorted(heap, reverse=True), 1)]
        for at in range(0, len(rows), 10_000):
            columns = list(zip(*rows[at : at + 10_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "rank", "vec_id", "score"])

    tiles = q.repartition(nq * nc, "d", "qb", "cb").groupBy("d", "qb", "cb").cogroup(c.repartition(nq * nc, "d", "qb", "cb").groupBy("d", "qb", "cb")).applyInArrow(meet, "query_id long, vec_id long, score double")
    return tiles.repartition(max(nq, 8), "query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")
