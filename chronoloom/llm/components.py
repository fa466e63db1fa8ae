"""Connected components by alternating large-star and small-star rounds
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, materialize


def _round(pairs: DataFrame, large: bool) -> DataFrame:
    """One star round over (a, b) with a > b: the minimum of each neighbourhood takes the others."""
    both = pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs.select("a", "b")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    near = both.join(least, "a")
    out = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(a, b) long pairs, in any order, to (doc, component): the smallest id that each
    id that is in a pair can reach. Null and equal ends are dropped; no pairs, no rows.

    The number of rounds grows with the logarithm of the longest chain. A hub of many
    neighbours is summed by a partial aggregate; its join is one that AQE can split."""
    now = materialize(pairs.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct())
    mark = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or state == mark:
            break
        mark = state
        before, now = now, materialize(_round(_round(now, True), False))
        discard(before)
    return now.select(F.col("a").alias("doc"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("doc"), F.col("b").alias("component"))).distinct()
