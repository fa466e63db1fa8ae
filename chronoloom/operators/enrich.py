"""Emphasis, switches and sections of a video's picture descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import UNKNOWN, readable, stretch_title, switch_label

# Reasons for emphasis and the limits behind them.
LOW_CONFIDENCE = "low confidence"
HARD_TO_READ = "hard to read"
ACTION = "something happened"
LONG_SILENCE = "long silence"
LONG_SILENCE_SECONDS = 30.0
HARD_FIELDS = 3


def unknown_count(*columns: str) -> Column:
    """How many fields hold exactly the sentinel."""
    return sum((F.when(F.col(c) == UNKNOWN, 1).otherwise(0) for c in columns), F.lit(0)).cast("int")


def emphasis(descriptions: DataFrame, fields: list[str], silences: DataFrame | None = None) -> DataFrame:
    """video_id, index (-1 for a silence), seconds, reasons."""
    reasons = F.array_compact(F.array(
        F.when(F.col("confidence") == "Low", LOW_CONFIDENCE),
        F.when(unknown_count(*fields) >= HARD_FIELDS, HARD_TO_READ),
        F.when(readable("action"), ACTION),
    ))
    out = descriptions.select("video_id", "index", "seconds", reasons.alias("reasons")).where(F.size("reasons") > 0)
    if silences is not None:
        long = silences.where(F.col("end") - F.col("start") >= LONG_SILENCE_SECONDS)
        out = out.unionByName(long.select("video_id", F.lit(-1).alias("index"), F.col("start").alias("seconds"), F.array(F.lit(LONG_SILENCE)).alias("reasons")))
    return out


def switches(descriptions: DataFrame) -> DataFrame:
    """Changes of instrument or timeframe against the last readable value of each."""
    w = Window.partitionBy("video_id").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    read = lambda c: F.when(readable(c), F.col(c))
    d = descriptions.select("video_id", "index", "seconds", read("instrument").alias("i"), read("timeframe").alias("t"))
    d = d.select("*", F.last("i", ignorenulls=True).over(w).alias("li"), F.last("t", ignorenulls=True).over(w).alias("lt"))
    d = d.where("coalesce(i <> li, false) or coalesce(t <> lt, false)")
    word = lambda *c: F.coalesce(*[F.col(x) for x in c], F.lit(UNKNOWN))
    d = d.select("video_id", "index", "seconds", word("li").alias("from_instrument"), word("i", "li").alias("to_instrument"), word("lt").alias("from_timeframe"), word("t", "lt").alias("to_timeframe"))
    return d.withColumn("label", switch_label("from_instrument", "to_instrument", "from_timeframe", "to_timeframe"))


def segments(descriptions: DataFrame, durations: DataFrame, minimum: float | None = 30.0) -> DataFrame:
    """video_id, start, end, title, instrument, timeframe; sections shorter than `minimum`
    fold into the one before, and a first one that is still short into the second, which
    keeps its own labels. minimum None: no folding."""
    first = lambda c: F.coalesce(F.min_by(c, F.when(readable(c), F.col("index"))), F.lit(UNKNOWN))
    opening = descriptions.groupBy("video_id").agg(first("instrument").alias("instrument"), first("timeframe").alias("timeframe"))
    bounds = durations.where("duration > 0").join(opening, "video_id", "left").select("video_id", "duration", F.lit(0.0).alias("start"), F.lit(-1).alias("index"), F.coalesce("instrument", F.lit(UNKNOWN)).alias("instrument"), F.coalesce("timeframe", F.lit(UNKNOWN)).alias("timeframe"))
    more = switches(descriptions).join(durations.where("duration > 0"), "video_id").select("video_id", "duration", F.col("seconds").alias("start"), "index", F.col("to_instrument").alias("instrument"), F.col("to_timeframe").alias("timeframe"))
    w = Window.partitionBy("video_id").orderBy("index")
    cut = bounds.unionByName(more).withColumn("end", F.coalesce(F.lead("start").over(w), F.col("duration"))).where("end > start")
    cut = cut.select("video_id", "index", F.bround("start", 3).alias("start"), F.bround("end", 3).alias("end"), "instrument", "timeframe")
    if minimum is not None:
        # islands open at the first section and at every one that is long enough by itself
        opens = (F.row_number().over(w) == 1) | (F.col("end") - F.col("start") >= minimum)
        cut = cut.withColumn("island", F.sum(F.when(opens, 1).otherwise(0)).over(w))
        cut = cut.groupBy("video_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("instrument", "index").alias("instrument"), F.min_by("timeframe", "index").alias("timeframe"), F.min("index").alias("index"))
        o = Window.partitionBy("video_id").orderBy("island")
        short = (F.col("island") == 1) & (F.col("end") - F.col("start") < minimum) & F.lead("island").over(o).isNotNull()
        cut = cut.withColumn("short", short)
        cut = cut.withColumn("start", F.when(F.lag("short").over(o), F.lag("start").over(o)).otherwise(F.col("start"))).where("not short")
    return cut.select("video_id", "start", "end", stretch_title("instrument", "timeframe").alias("title"), "instrument", "timeframe")


def coverage(descriptions: DataFrame, fields: list[str]) -> DataFrame:
    """Per field: rows, unknown, filled, distinct readable values."""
    long = descriptions.unpivot([], fields, "field", "value")
    return long.groupBy("field").agg(F.count("*").alias("n_rows"), F.count_if(F.col("value") == UNKNOWN).alias("unknown"), F.count_if(readable("value")).alias("filled"), F.count_distinct(F.when(readable("value"), F.col("value"))).alias("distinct_values"))
