"""Readers of evidence files: JSON manifests with explicit schemas, and path listings.
Unknown keys are dropped and missing ones take defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.timefmt import hms
from ..operators.timeline import KEYS, exported

FRAMES = "source_filename string, duration_seconds double, frames array<struct<index:int, timestamp_seconds:double, timestamp:string, clean_filename:string, api_filename:string, batch_id:string, batch_index:int>>"
TRANSCRIPT = "source_filename string, segments array<struct<start_seconds:double, end_seconds:double, text:string, is_silence:boolean>>"
DESCRIPTIONS = "descriptions array<struct<index:int, timestamp_seconds:double, " + ", ".join(f"{key}:string" for key in KEYS.values()) + ", confidence:string, clean_filename:string>>, skips array<struct<index:int, reason:string, attempts:int>>"
SILENCES = "windows array<struct<start:double, `end`:double>>"
RERUN = "scope string, from_version int, indices array<int>, carried_over int"


def _json(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(paths)
    return raw.withColumn("video_id", F.element_at(F.split(F.input_file_name(), "/"), -2))


def frames(spark: SparkSession, paths) -> DataFrame:
    return _json(spark, paths, FRAMES).select("video_id", F.inline("frames"))


def transcript(spark: SparkSession, paths) -> DataFrame:
    rows = _json(spark, paths, TRANSCRIPT).select("video_id", F.posexplode("segments").alias("line", "s"))
    return rows.select("video_id", "line", "s.start_seconds", "s.end_seconds", F.coalesce("s.text", F.lit("")).alias("text"), F.coalesce("s.is_silence", F.lit(False)).alias("is_silence"))


def descriptions(spark: SparkSession, paths) -> DataFrame:
    """Pictures in this library's names, with the number of pictures that were skipped; unreadable files give no rows."""
    d = _json(spark, paths, DESCRIPTIONS)
    rows = d.select("video_id", F.coalesce(F.size("skips"), F.lit(0)).alias("skipped"), F.inline(F.coalesce("descriptions", F.array().cast(d.schema["descriptions"].dataType))))
    return rows.withColumnsRenamed({key: name for name, key in KEYS.items()} | {"timestamp_seconds": "seconds", "clean_filename": "frame"})


def skips(spark: SparkSession, paths) -> DataFrame:
    """video_id, skipped, described: one row for each description file, also of those that describe nothing."""
    d = _json(spark, paths, DESCRIPTIONS)
    return d.select("video_id", *[F.coalesce(F.size(F.when(F.col(c).isNotNull(), F.col(c))), F.lit(0)).alias(name) for c, name in (("skips", "skipped"), ("descriptions", "described"))])


def timeline(spark: SparkSession, transcripts, described=None) -> DataFrame:
    """Entries (as `exported`) of videos' transcript files and, where there are any, description files.
    Descriptions are optional; those of a video without a transcript file are an error when the
    rows are read, and no transcript file at all is one at once."""
    files = _json(spark, transcripts, TRANSCRIPT).select("video_id").distinct()
    if described is None:
        nothing = spark.createDataFrame([], "video_id string, seconds double, confidence string, frame string, index int, " + ", ".join(f"{name} string" for name in KEYS))
        return exported(transcript(spark, transcripts), nothing)
    seen = descriptions(spark, described).join(files.withColumn("_there", F.lit(True)), "video_id", "left")
    no_transcript = F.raise_error(F.concat(F.lit("no transcript of video "), F.col("video_id")))
    seen = seen.withColumn("index", F.when(F.col("_there"), F.col("index")).otherwise(no_transcript.cast("int")))
    return exported(transcript(spark, transcripts), seen)


def silences(spark: SparkSession, paths) -> DataFrame:
    return _json(spark, paths, SILENCES).select("video_id", F.inline("windows"))


def rerun_plans(spark: SparkSession, paths) -> DataFrame:
    r = _json(spark, paths, RERUN)
    return r.select("video_id", F.coalesce("scope", F.lit("all")).alias("scope"), F.coalesce("from_version", F.lit(1)).alias("from_version"), F.coalesce("indices", F.array().cast("array<int>")).alias("indices"), F.coalesce("carried_over", F.lit(0)).alias("carried_over"))


def log_lines(spark: SparkSession, paths) -> DataFrame:
    """video_id, line_no, line of text logs: the place in the file orders the lines."""
    t = spark.read.text(paths, wholetext=True).withColumn("video_id", F.element_at(F.split(F.input_file_name(), "/"), -2))
    return t.select("video_id", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def picture_listing(paths: DataFrame) -> DataFrame:
    """folder, filename, index, seconds and label of each .jpg of a path listing (path), by its name
    NNNNNN_tHHMMSS.jpg; without a number the place in its folder, without a time 0."""
    p = paths.where(F.endswith("path", F.lit(".jpg"))).select(F.regexp_replace("path", "/?[^/]*$", "").alias("folder"), F.regexp_extract("path", "[^/]*$", 0).alias("filename"))
    place = F.row_number().over(Window.partitionBy("folder").orderBy("filename")) - 1
    stem = F.regexp_replace("filename", "\\.jpg$", "")
    number = F.nullif(F.regexp_extract(stem, "^([0-9]+)_t", 1), F.lit("")).cast("long")
    digits = F.regexp_extract(stem, "^(?:(?!_t).)*_t([0-9]{6})$", 1)
    two = lambda k: F.nullif(F.substring(digits, k, 2), F.lit("")).cast("long")
    seconds = F.coalesce(two(1) * 3600 + two(3) * 60 + two(5), F.lit(0).cast("long"))
    return p.select("folder", "filename", F.coalesce(number, place).alias("index"), seconds.alias("seconds"), hms(seconds).alias("label"))


def importable(paths: DataFrame) -> DataFrame:
    """Folders of a path listing (path) that hold an assembled document, each once, apart from
    copies kept for analysis."""
    p = paths.where(F.element_at(F.split("path", "/"), -1) == "assembled.txt").select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"))
    return p.where(~F.array_contains(F.split("folder", "/"), "analysis_input")).distinct()


def inspect(folders: DataFrame, paths: DataFrame, manifests: DataFrame, described: DataFrame, schema_hash: str) -> DataFrame:
    """Importable folders with warnings about what is beside the document, and one word. manifests:
    folder, readable, pictures (how many it lists); described: folder, readable, hash (null for no rows)."""
    beside = paths.select(F.regexp_replace("path", "/(?:frames/)?[^/]*$", "").alias("folder"), F.col("path").rlike("/frames/[^/]*\\.jpg$").alias("picture"))
    have = beside.groupBy("folder").agg(F.bool_or("picture").alias("pictures"))
    m = manifests.select("folder", F.col("readable").alias("m_ok"), F.col("pictures").alias("listed"))
    v = described.select("folder", F.col("readable").alias("v_ok"), "hash")
    out = folders.join(have, "folder", "left").join(m, "folder", "left").join(v, "folder", "left")
    lists = F.when(F.col("m_ok").isNull(), "there is no picture list, so pictures cannot be checked").when(~F.col("m_ok"), "the picture list could not be read")
    missing = ~F.coalesce("pictures", F.lit(False)) & F.coalesce(F.col("m_ok") & (F.col("listed") > 0), F.lit(False))
    older = F.coalesce(F.col("v_ok") & (F.col("hash") != schema_hash), F.lit(False))
    words = F.when(F.col("v_ok").isNull(), "no descriptions").when(~F.col("v_ok"), "the descriptions could not be read").when(older, "older wording")
    warnings = F.array_compact(F.array(lists, F.when(missing, "the pictures are missing"), words))
    compatibility = F.when(missing, "missing_artifacts").when(older, "provenance_mismatch").when(F.col("v_ok").isNull(), "no_visual").otherwise("ok")
    return out.select("folder", warnings.alias("warnings"), compatibility.alias("compatibility"))


PROBE = "format struct<duration:string, format_name:string, size:string>, streams array<struct<codec_type:string, codec_name:string, duration:string, width:int, height:int>>"


def probe(outputs: DataFrame) -> DataFrame:
    """ffprobe's JSON (video_id, json) to container, codecs, size of the picture and duration: the
    container's, else the first video stream's; problem says where there is no duration above 0."""
    x = outputs.select("video_id", F.from_json("json", PROBE).alias("p"))
    first = lambda kind: F.try_element_at(F.filter("p.streams", lambda s: s["codec_type"] == kind), F.lit(1))
    v, a = first("video"), first("audio")
    positive = lambda c: F.when(c.try_cast("double") > 0, c.try_cast("double"))
    seconds = F.coalesce(positive(F.col("p.format.duration")), positive(v["duration"]))
    problem = F.when(F.col("p").isNull() | v.isNull(), "no video stream").when(seconds.isNull(), "no duration")
    return x.select("video_id", F.col("p.format.format_name").alias("container"), v["codec_name"].alias("video_codec"), a["codec_name"].alias("audio_codec"), v["width"].alias("width"), v["height"].alias("height"), seconds.alias("seconds"), problem.alias("problem"))
