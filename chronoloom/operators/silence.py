"""Silences: log parsing, closing, inversion to speech and padding. One video is one partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def parse_log(lines: DataFrame) -> DataFrame:
    """(video_id, line_no, line) to (video_id, start, end). A start opens, a later start
    replaces it, the next end closes; negative starts are 0; empty windows go."""
    number = r"(-?\d+(?:\.\d+)?)"
    start = F.regexp_extract("line", rf"silence_start:\s*{number}", 1).try_cast("double")
    end = F.regexp_extract("line", rf"silence_end:\s*{number}", 1).try_cast("double")
    marks = lines.select("video_id", "line_no", start.alias("s"), end.alias("e")).where("s is not null or e is not null")
    w = Window.partitionBy("video_id").orderBy("line_no")
    # an end closes only if the mark just before it is a start: an earlier one is closed already
    pairs = marks.withColumn("open", F.lag("s").over(w)).where("e is not null and open is not null")
    return pairs.select("video_id", F.greatest("open", F.lit(0.0)).alias("start"), F.col("e").alias("end")).where("end > start")


def close_trailing(lines: DataFrame, windows: DataFrame, durations: DataFrame) -> DataFrame:
    """Adds (last start, duration) where a video's log has more starts than ends."""
    s = F.regexp_extract("line", r"silence_start:\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    e = F.regexp_extract("line", r"silence_end:\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    counts = lines.select("video_id", "line_no", s.alias("s"), e.alias("e")).groupBy("video_id").agg(F.count("s").alias("ns"), F.count("e").alias("ne"), F.max_by("s", F.when(F.col("s").isNotNull(), F.col("line_no"))).alias("last"))
    tail = counts.where("ns > ne").join(durations, "video_id").select("video_id", F.greatest("last", F.lit(0.0)).alias("start"), F.col("duration").alias("end")).where("end > start")
    return windows.unionByName(tail)


def invert(silences: DataFrame, durations: DataFrame, padding: float = 0.25) -> DataFrame:
    """Silences (video_id, start, end) to speech windows (video_id, start, end), padded
    without overlap, to 3 decimals."""
    cut = silences.join(durations, "video_id").select("video_id", "duration", F.least(F.greatest("start", F.lit(0.0)), "duration").alias("start"), F.least("end", "duration").alias("end"))
    ends = durations.select("video_id", "duration", F.col("duration").alias("start"), F.col("duration").alias("end"))
    w = Window.partitionBy("video_id").orderBy("start", "end")
    before = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    speech = cut.unionByName(ends).select("video_id", "duration", before.alias("from"), F.col("start").alias("to")).where("to > from")
    o = Window.partitionBy("video_id").orderBy("from")
    padded_end = lambda c: F.least(F.col("duration"), c + padding)
    start = F.greatest(F.lit(0.0), F.col("from") - padding, F.coalesce(F.lag(padded_end(F.col("to"))).over(o), F.lit(0.0)))
    start = F.least(start, F.coalesce(F.lead("from").over(o), start))
    out = speech.select("video_id", start.alias("start"), padded_end(F.col("to")).alias("end")).where("end > start")
    return out.select("video_id", F.bround("start", 3).alias("start"), F.bround("end", 3).alias("end"))


def totals(silences: DataFrame) -> DataFrame:
    return silences.groupBy("video_id").agg(F.count("*").alias("windows"), F.bround(F.sum((F.col("end") - F.col("start")).cast("decimal(18,3)")), 3).alias("silent_seconds"))
