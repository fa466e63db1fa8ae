"""Describing again: which pictures a rerun targets, what it carries over, merging and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def targets(pictures: DataFrame, previous: DataFrame, scope: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """video_id, index of the pictures in scope: all, low (confidence), missing or range
    (inclusive, swapped ends tolerated)."""
    every = pictures.select("video_id", "index")
    if scope == "all":
        return every
    if scope == "low":
        return previous.where(F.lower("confidence") == "low").select("video_id", "index")
    if scope == "missing":
        return every.join(previous.select("video_id", "index"), ["video_id", "index"], "left_anti")
    if scope == "range":
        a, b = (0 if first is None else first), (2**31 - 1 if last is None else last)
        return every.where(F.col("index").between(min(a, b), max(a, b)))
    raise ValueError(scope)


def carried(previous: DataFrame, aimed: DataFrame) -> DataFrame:
    return previous.join(aimed, ["video_id", "index"], "left_anti")


def merged(new: DataFrame, old: DataFrame) -> DataFrame:
    """New descriptions, and old ones where there is no new one."""
    both = new.withColumn("_old", F.lit(0)).unionByName(old.withColumn("_old", F.lit(1)))
    rest = [c for c in both.columns if c not in ("video_id", "index", "_old")]
    best = both.groupBy("video_id", "index").agg(F.min_by(F.struct(*rest), F.col("_old")).alias("r"))
    return best.select("video_id", "index", *[F.col(f"r.{c}").alias(c) for c in rest])


def activate(videos: DataFrame, chosen: DataFrame) -> DataFrame:
    """Exactly the chosen version of each place is active; places without a choice keep theirs."""
    c = chosen.select("job_id", "sequence", F.col("version").alias("_v"))
    return videos.join(c, ["job_id", "sequence"], "left").withColumn("active", F.coalesce(F.col("version") == F.col("_v"), F.col("active"))).drop("_v")


def next_version(videos: DataFrame) -> DataFrame:
    return videos.groupBy("job_id", "sequence").agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def siblings(videos: DataFrame, anchors: DataFrame) -> DataFrame:
    """All versions of the places of the anchor rows (job_id, sequence)."""
    return videos.join(anchors.select("job_id", "sequence").distinct(), ["job_id", "sequence"], "left_semi")


def describe_versions(videos: DataFrame) -> DataFrame:
    w = Window.partitionBy("job_id", "sequence").orderBy("version")
    return videos.select("job_id", "sequence", "version", F.row_number().over(w).alias("ordinal"), "active")
