"""The files of a finished video as sorted lines for `text_files.write_texts`: transcript (JSON and text) and gaps.

Every segment and every missing picture is a line of its own, put in order by a sort, so that no row and no group holds a
video. A file's name is the video's id, escaped as in an address, and the file's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.timefmt import hms
from . import ranks

# Names of files and the wording of a gaps file.
TRANSCRIPT, TRANSCRIPT_TEXT, GAPS = "transcript.json", "transcript.txt", "gaps.txt"
GAPS_HEAD = "{} picture(s) have no description.\n\nEverything else in this video was processed normally. You can ask for\nthese to be described again later without redoing any other work.\n\n"


def _name(file: str) -> Column:
    return F.concat(F.url_encode(F.col("video_id").cast("string")), F.lit("/" + file)).alias("name")


def _line(rows: DataFrame, file: str, section: int, item: Column, text: Column) -> DataFrame:
    return rows.select(_name(file), F.lit(section).alias("section"), item.cast("long").alias("item"), text.alias("text"))


def transcript_lines(said: DataFrame, videos: DataFrame) -> DataFrame:
    """Both files of each video in `videos` (video_id, filename, provenance, a JSON object as text, null for none).
    said: video_id, line, start_seconds, end_seconds, text, is_silence. Segments stand in order of time, speech before
    silence, then line; a null text is empty; a video without segments has a JSON with an empty list and a text of one empty line;
    segments of unknown videos are in no file."""
    t = said.withColumn("text", F.coalesce("text", F.lit(""))).join(videos.select("video_id"), "video_id", "left_semi")
    t = ranks.ranked(t, "start_seconds", "is_silence", "line", by=("video_id",), name="_place")
    n = videos.join(t.groupBy("video_id").agg(F.max("_place").alias("_n")), "video_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    segment = F.to_json(F.struct("start_seconds", "end_seconds", hms("start_seconds").alias("timestamp"), "text", "is_silence"))
    named = F.to_json(F.struct(F.lit(1).alias("version"), F.coalesce("filename", F.lit("")).alias("source_filename")))
    head = F.concat(F.rtrim(named, F.lit("}")), F.lit(',"provenance":'), F.coalesce("provenance", F.lit("{}")), F.lit(',"segment_count":'), F.col("_n").cast("string"), F.lit(',"segments":['))
    first = F.col("_place") == 1
    return (
        _line(n, TRANSCRIPT, 0, F.lit(0), head)
        .unionByName(_line(t, TRANSCRIPT, 1, F.col("_place"), F.concat(F.when(first, "\n").otherwise(",\n"), segment)))
        .unionByName(_line(n, TRANSCRIPT, 2, F.lit(0), F.lit("]}\n")))
        .unionByName(_line(t, TRANSCRIPT_TEXT, 0, F.col("_place"), F.concat(hms("start_seconds"), F.lit("  "), "text", F.lit("\n"))))
        .unionByName(_line(n.where("_n = 0"), TRANSCRIPT_TEXT, 0, F.lit(0), F.lit("\n")))
    )


def gap_lines(skips: DataFrame) -> DataFrame:
    """A gaps file for each video with missing pictures; the others have none. skips: video_id, index (from 0), reason
    (null counts as empty); several of one index all count, in order of their reasons."""
    s = ranks.ranked(skips.withColumn("reason", F.coalesce("reason", F.lit(""))), "index", "reason", by=("video_id",), name="_place")
    n = s.groupBy("video_id").agg(F.max("_place").alias("_n"))
    number = F.lpad((F.col("index") + 1).cast("string"), F.greatest(F.lit(6), F.length((F.col("index") + 1).cast("string"))), F.lit(" "))
    head = F.concat(F.col("_n").cast("string"), F.lit(GAPS_HEAD.removeprefix("{}")))
    return _line(n, GAPS, 0, F.lit(0), head).unionByName(_line(s, GAPS, 1, F.col("_place"), F.concat(F.lit("  picture "), number, F.lit("   "), "reason", F.lit("\n"))))
