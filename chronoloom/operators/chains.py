"""Greedy chains over ordered rows, also where one key holds most of them.

A chain has a start; the next start is the first later row that doesn't fit with it, and so on: parts of a
budget (a row doesn't fit when the sum from the start passes the limit) and throttles (a row is let through when
`gap` has passed since the last one). Which rows are starts depends on all rows before, yet not much: from
one row on the chain is fixed, so a run of rows maps the state at its entry to that at its exit by a
few steps.

Rows are sorted by ranges, and a block is what one range holds of a key. Each row's next start is found by
binary search in sums, ends of chains by pointer doubling, and the block's map of states
is written with its rows. Only the first and the last key of a range can go on in other ranges, so there are two maps a range at
most; following them gives the state in which each block is entered, one small row a range, and
then all blocks mark their starts on their own. Chains of different starts soon meet, so a map has no more steps than rows
fit into one part; in the worst case (a block that fits into one part) it has as many as the block has rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from ..sources.scratch import written

_MAP = ArrayType(DoubleType())


class Links:
    """The chains of one block. a: what must pass `base + limit` to be the next start; base: of a chain that starts
    in each row; alone: rows that are a chain by themselves."""

    def __init__(self, a: np.ndarray, base: np.ndarray, alone: np.ndarray, limit: float, strict: bool):
        self.n, self.a, self.base, self.limit, self.side = len(a), a, base, limit, "right" if strict else "left"
        forced = np.append(alone, False)
        forced[1:] |= alone
        at = np.flatnonzero(forced[: self.n])
        self.forced = np.append(at, self.n)[np.searchsorted(at, np.arange(self.n + 1))]
        self.alone = alone
        found = np.minimum(np.searchsorted(a, base + limit, side=self.side), self.forced[1:])
        self.next = np.maximum(found, np.arange(1, self.n + 1))

    def first(self, state: float) -> int:
        """The first start after a chain that began at `state`; n for none."""
        return int(min(np.searchsorted(self.a, state + self.limit, side=self.side), self.forced[0]))

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """The last start and the number of starts of the chain from each row, by pointer doubling."""
        to, count, last = np.append(self.next, self.n), np.ones(self.n + 1, dtype=np.int64), np.arange(self.n + 1)
        count[self.n] = 0
        while (to[: self.n] < self.n).any():
            last = np.where(to < self.n, last[to], last)
            count = count + count[to]
            to = to[to]
        return last[: self.n], count[: self.n]

    def steps(self, largest: float, shift: float) -> tuple[list, list, list]:
        """Limits, exit states and counts: a chain that began at `state` takes the first step whose limit passes
        state + self.limit; behind all steps it goes on through the block. largest: the latest state at which a chain
        can have begun before this block; shift: what states lose on the way out."""
        most = min(self.first(largest) + 1, self.n)
        last, count = (x[:most] for x in self.ends())
        out = np.where(self.alone[last], -np.inf, self.base[last] - shift)
        limit = self.a[:most].copy()
        if self.forced[0] < self.n and self.forced[0] < most:
            limit[self.forced[0] :] = np.inf
        keep = np.ones(most, dtype=bool)
        keep[:-1] = (out[1:] != out[:-1]) | (count[1:] != count[:-1])
        return limit[keep].tolist(), out[keep].tolist(), count[keep].astype(float).tolist()

    def marks(self, state: float) -> np.ndarray:
        out = np.zeros(self.n, dtype=bool)
        at, following = self.first(state), self.next.tolist()
        while at < self.n:
            out[at] = True
            at = following[at]
        return out


def _links(batch: pa.RecordBatch | pa.Table, strict: bool) -> tuple[Links, float, float]:
    """The block's links, the latest state before it and what states lose behind it."""
    value = np.asarray(batch.column("_value"), dtype=np.float64)
    alone = np.asarray(batch.column("_alone").to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column("_alone").combine_chunks().to_numpy(zero_copy_only=False), dtype=bool)
    limit = batch.column("_limit")[0].as_py()
    if strict:
        total = np.cumsum(value)
        return Links(total, total - value, alone, limit, True), 0.0, float(total[-1])
    return Links(value, value, alone, limit, False), float(value[0]), 0.0


def _runs(batches, *columns: str):
    """Tables of neighbouring rows that are equal in the columns."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        keys = list(zip(*[batch.column(c).to_pylist() for c in columns], strict=True))
        at = 0
        for k in range(1, len(keys) + 1):
            if k == len(keys) or keys[k] != keys[at]:
                if held and keys[at] != now:
                    yield pa.Table.from_batches(held)
                    held = []
                now = keys[at]
                held.append(batch.slice(at, k - at))
                at = k
    if held:
        yield pa.Table.from_batches(held)


def _mapped(strict: bool):
    """Adds the map of states to the last row of each range's first and last block."""

    def run(batches):
        first, before = True, None

        def out(table, wanted):
            maps: list = [None] * table.num_rows
            if wanted:
                links, largest, shift = _links(table, strict)
                limits, states, counts = links.steps(largest, shift)
                maps[-1] = [links.limit, shift, float(len(limits)), *limits, *states, *counts]
            yield from table.append_column("_map", pa.array(maps, pa.list_(pa.float64()))).to_batches(max_chunksize=10_000)

        for table in _runs(batches, "_key"):
            if before is not None:
                yield from out(before, first)
                first = False
            before = table
        if before is not None:
            yield from out(before, True)

    return run


def _entries(kind, strict: bool):
    """Follow a key's maps from range to range: the state and the starts so far at each block but its first."""

    def run(batches):
        for table in _runs(batches, "_key"):
            state, count, rows = -np.inf, 0, []
            for part, own in zip(table.column("_part").to_pylist(), table.column("_map").to_pylist(), strict=True):
                if rows or count:
                    rows.append((part, state, count))
                limit, shift, n = own[0], own[1], int(own[2])
                limits, states, counts = own[3 : 3 + n], own[3 + n : 3 + 2 * n], own[3 + 2 * n :]
                k = int(np.searchsorted(limits, state + limit, side="right" if strict else "left"))
                state, count = (states[k], count + int(counts[k])) if k < n else (state - shift, count)
            if rows:
                part, state, count = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), table.column("_key").combine_chunks().slice(0, 1).take(pa.array([0] * len(part))), pa.array(state, pa.float64()), pa.array(count, pa.int64())], names=["_part", "_key", "_state", "_before"])

    return run


def _marked(strict: bool):
    def run(batches):
        for table in _runs(batches, "_part", "_key"):
            links, _, _ = _links(table, strict)
            state, before = table.column("_state")[0].as_py(), table.column("_before")[0].as_py()
            start = links.marks(-np.inf if state is None else state)
            number = np.cumsum(start) + (before or 0)
            out = table.select(["_row"]).append_column("_start", pa.array(start)).append_column("_number", pa.array(number, pa.int64()))
            yield from out.to_batches(max_chunksize=10_000)

    return run


def starts(rows: DataFrame, key: str, order: list[str], value: Column, limit: Column, alone: Column | None = None, sums: bool = True) -> DataFrame:
    """rows with _start (whether a chain starts there) and _number (that of its chain within the key, from 1), in the given order.
    sums: a row starts a chain when the sum of values from the start passes the limit; else when its value (which
    ascends in the order) is at least the limit past the start's. The limit is one number a key; rows of a null key are one key.
    Rows that are alone are chains of their own."""
    x = rows.select(F.struct(*[rows[f"`{c}`"] for c in rows.columns]).alias("_row"), F.col(key).alias("_key"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], value.cast("double").alias("_value"), limit.cast("double").alias("_limit"), F.coalesce(alone if alone is not None else F.lit(False), F.lit(False)).alias("_alone"))
    by = ["_key", *[f"_o{k}" for k in range(len(order))]]
    dealt = x.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).drop(*by[1:])
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33))
    held = written(dealt.mapInArrow(_mapped(sums), StructType([*dealt.schema.fields, StructField("_map", _MAP)])))
    kind = dealt.schema["_key"].dataType
    # two rows a range at most
    maps = held.where("_map is not null").select("_key", "_part", "_map").repartition("_key").sortWithinPartitions("_key", "_part")
    entered = maps.mapInArrow(_entries(kind, sums), StructType([StructField("_part", LongType()), StructField("_key", kind), StructField("_state", DoubleType()), StructField("_before", LongType())]))
    entered = entered.withColumnsRenamed({"_part": "_p", "_key": "_k"})
    met = held.drop("_map").join(F.broadcast(entered), (F.col("_part") == F.col("_p")) & F.col("_key").eqNullSafe(F.col("_k")), "left").drop("_p", "_k")
    out = met.repartition("_part").sortWithinPartitions("_part", "_at").mapInArrow(_marked(sums), StructType([dealt.schema["_row"], StructField("_start", BooleanType()), StructField("_number", LongType())]))
    return out.select("_row.*", "_start", "_number")
