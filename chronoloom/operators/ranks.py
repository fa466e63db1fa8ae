"""Places in a global order, without one task that sees all rows.

Rows are dealt by ranges of the order, sorted in each range and written once with their place in
it; the sizes of the ranges before it (one number for each range) make that the place among all.
Rows that are equal in the whole order get neighbouring places in any order; end the order with a key where
that matters. Nulls stand where the order puts them; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import written


def _before(held: DataFrame, *keys: str) -> DataFrame:
    """keys, _part and _start (rows of the key in earlier ranges) where that isn't 0: at most one row for each range,
    because only the first key of a range can have begun in an earlier one."""
    sizes = held.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_start", F.sum("_n").over(earlier)).where("_start > 0").drop("_n")


def ranked(rows: DataFrame, *order: Column | str, by: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """rows with the place (from 1) in the order; within each key, if `by` names columns of a key
    (nulls are one key). A hot key lies in many ranges, of which only the counts meet."""
    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    # the id is the number of the range and the row's place in it
    held = written(dealt.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    place = F.col("_at") - F.shiftleft("_part", 33) + 1
    if by:
        place = F.row_number().over(Window.partitionBy("_part", *by).orderBy("_at"))
    start = _before(held, *by).select("_start", *[F.col(c).alias(f"_key{k}") for k, c in enumerate(("_part", *by))])
    placed = held.withColumn("_place", place)
    same = [placed[c].eqNullSafe(F.col(f"_key{k}")) for k, c in enumerate(("_part", *by))]
    met = placed.join(F.broadcast(start), same, "left")
    return met.select(*[placed[f"`{c}`"] for c in rows.columns], (F.coalesce("_start", F.lit(0)) + F.col("_place")).alias(name))


def at_rank(rows: DataFrame, value: str, place: Column, *by: str) -> DataFrame:
    """For each key the value whose place in ascending order is `place` of `_count` (nulls left out):
    by, value."""
    placed = ranked(rows.where(F.col(value).isNotNull()).select(*by, value), value, by=by, name="_rank")
    counts = placed.groupBy(*by).agg(F.max("_rank").alias("_count"))
    wanted = counts.select(place.cast("long").alias("_want"), *[F.col(c).alias(f"_key{k}") for k, c in enumerate(by)])
    # key and place together are unique, so that a hot key is no hot key of the join
    same = [placed["_rank"] == F.col("_want"), *[placed[c].eqNullSafe(F.col(f"_key{k}")) for k, c in enumerate(by)]]
    return placed.join(wanted, same).select(*by, value)


def page(rows: DataFrame, number: int, size: int, *order: Column | str) -> DataFrame:
    """Page `number` of the ordered rows, clamped to the first and the last one, with columns rank, page, pages."""
    placed = ranked(rows, *order)
    total = placed.agg(F.max("rank")).first()[0] or 0
    pages = max(1, -(-total // size))
    now = min(max(1, number), pages)
    return placed.where(F.col("rank").between((now - 1) * size + 1, now * size)).withColumns({"page": F.lit(now), "pages": F.lit(pages)})
