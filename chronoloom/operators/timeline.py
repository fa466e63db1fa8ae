"""One time-ordered sequence from speech, silences, pictures and headings, and its documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import readable, strip
from ..functions.timefmt import hms, subtitle_time

# The order of kinds within one second.
DOCUMENT_ORDER = ("heading", "silence", "speech", "description")
EXPORT_ORDER = ("silence", "speech", "description")
# The labels of a description's fields, in the order of the document.
FIELDS = (("chart", "instrument"), ("timeframe", "timeframe"), ("on screen", "states"), ("happening", "action"), ("text", "visible"), ("in words", "words"), ("kind", "setup"))
# The names of the fields in files.
KEYS = {"instrument": "currency_pair", "timeframe": "timeframe", "states": "indicators_and_states", "action": "exact_action", "visible": "visible_text", "words": "visual_description", "setup": "setup_type"}
# What a document says before its lines.
INTRODUCTION = ("Everything below is in the order it happened. Times are from the start", "of the video.", "")


def rank(kind: Column, order: tuple[str, ...]) -> Column:
    out = F.lit(9)
    for k, name in enumerate(order):
        out = F.when(kind == name, k).otherwise(out)
    return out


def weave(speech: DataFrame, silences: DataFrame) -> DataFrame:
    """Speech lines and silences as one transcript: speech before a silence of the same start."""
    length = F.bround(F.col("end") - F.col("start"), 0).cast("long")
    quiet = silences.select("video_id", F.col("start").alias("start_seconds"), F.col("end").alias("end_seconds"), F.format_string("[nobody speaking · %d seconds]", length).alias("text"), F.lit(True).alias("is_silence"))
    both = speech.select("video_id", "start_seconds", "end_seconds", "text", "is_silence").unionByName(quiet)
    w = Window.partitionBy("video_id").orderBy("start_seconds", "is_silence", "end_seconds", "text")
    return both.withColumn("ordinal", F.row_number().over(w))


def picture_block(fields=FIELDS, emphasis: Column | None = None) -> Column:
    """Lines of one description: readable fields with labels, a count of the others, the confidence.
    emphasis (a text, null for none) stands behind the number."""
    missing = sum((F.when(readable(c), 0).otherwise(1) for _, c in fields), F.lit(0))
    number = F.format_string("  picture %d", F.col("index") + 1)
    lines = [number if emphasis is None else F.concat(number, F.coalesce(F.concat(F.lit("  ["), emphasis, F.lit("]")), F.lit("")))]
    lines += [F.when(readable(c), F.concat(F.lit(f"    {label}: "), F.col(c))) for label, c in fields]
    lines.append(F.when(missing > 0, F.format_string("    (%d detail(s) could not be read in this picture)", missing)))
    lines.append(F.when(F.col("confidence") != "", F.concat(F.lit("    confidence: "), F.col("confidence"))))
    return F.concat_ws("\n", *lines)


def entries(transcript: DataFrame, descriptions: DataFrame, segments: DataFrame | None = None, emphasis: DataFrame | None = None) -> DataFrame:
    """video_id, seconds, kind, text, tie (the order of equal seconds and kinds). emphasis: video_id,
    index and reasons of pictures, each once; rows of an index that no picture has are silences'."""
    label = None
    if emphasis is not None:
        marked = emphasis.where("index >= 0").select("video_id", "index", F.array_join("reasons", ", ").alias("label"))
        descriptions, label = descriptions.join(marked, ["video_id", "index"], "left"), F.col("label")
    said = transcript.select("video_id", F.col("start_seconds").alias("seconds"), F.when(F.col("is_silence"), "silence").otherwise("speech").alias("kind"), F.concat(F.lit("  "), F.col("text")).alias("text"), F.col("line").cast("long").alias("tie"))
    seen = descriptions.select("video_id", "seconds", F.lit("description").alias("kind"), picture_block(emphasis=label).alias("text"), F.col("index").cast("long").alias("tie"))
    out = said.unionByName(seen)
    if segments is not None:
        title = F.concat(F.lit("\n── "), F.col("title"), F.lit(" ("), hms("start"), F.lit(" to "), hms("end"), F.lit(") ──"))
        out = out.unionByName(segments.select("video_id", F.col("start").alias("seconds"), F.lit("heading").alias("kind"), title.alias("text"), F.lit(0).cast("long").alias("tie")))
    return out


def ordered(rows: DataFrame, order: tuple[str, ...] = DOCUMENT_ORDER) -> DataFrame:
    w = Window.partitionBy("video_id").orderBy("seconds", rank(F.col("kind"), order), "tie")
    return rows.withColumn("ordinal", F.row_number().over(w))


def lines(rows: DataFrame) -> DataFrame:
    """Document lines: a time before each entry, none before a heading."""
    stamped = F.when(F.col("kind") == "heading", F.col("text")).otherwise(F.concat(hms("seconds"), F.col("text")))
    return ordered(rows).select("video_id", "ordinal", "kind", stamped.alias("line"))


def _number(x: Column) -> Column:
    """Up to three decimals without trailing zeros."""
    return F.regexp_replace(x.cast("decimal(20,3)").cast("string"), r"\.?0+$", "")


def document(rows: DataFrame, names: DataFrame) -> DataFrame:
    """One text for each video: header, counts and ordered lines. names: video_id, name, duration and,
    where they are known, interval_ms, pictures (how many there are, described or not) and gaps."""
    body = lines(rows).groupBy("video_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda x: x["line"]), "\n").alias("body"),
        F.count_if(F.col("kind") == "description").alias("described"),
        F.count_if(F.col("kind").isin("speech", "silence")).alias("said"),
        F.count_if(F.col("kind") == "heading").alias("sections"),
    )
    rule = "=" * 72
    for column in ("interval_ms", "pictures", "gaps"):
        names = names if column in names.columns else names.withColumn(column, F.lit(None).cast("long"))
    d = names.join(body, "video_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    head = F.concat_ws(
        "\n", F.lit(rule), F.col("name"), F.lit(rule), F.concat(F.lit("Length            "), hms("duration")),
        F.when(n("interval_ms") > 0, F.concat(F.lit("Picture every     "), _number(F.col("interval_ms") / 1000), F.lit(" seconds"))),
        F.when(F.col("pictures").isNotNull(), F.format_string("Pictures          %,d", F.col("pictures"))),
        F.when(F.col("pictures").isNotNull(), F.format_string("Described         %,d", n("described"))).otherwise(F.format_string("Described         %,d picture(s)", n("described"))),
        F.format_string("Transcript lines  %,d", n("said")),
        F.when(n("gaps") > 0, F.format_string("Missing           %,d picture(s) have no description (see gaps.txt)", n("gaps"))),
        F.when(n("sections") > 0, F.format_string("Sections          %d", n("sections"))), F.lit(""), *map(F.lit, INTRODUCTION),
    )
    return d.select("video_id", F.concat(F.concat_ws("\n", head, F.col("body")), F.lit("\n")).alias("text"))


def exported(transcript: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Entries of the exporters: video_id, seconds, kind, text, end, frame, confidence, fields, tie. A
    description's text is its sentence in words, its fields are the other readable ones; empty for
    a sentence that isn't readable, null for no fields."""
    text, map_type = "string", "map<string,string>"
    null = lambda kind: F.lit(None).cast(kind)
    said = transcript.select(
        "video_id", F.coalesce("start_seconds", F.lit(0.0)).alias("seconds"), F.when(F.coalesce("is_silence", F.lit(False)), "silence").otherwise("speech").alias("kind"), strip(F.coalesce("text", F.lit(""))).alias("text"),
        F.coalesce("end_seconds", F.lit(0.0)).alias("end"), null(text).alias("frame"), null(text).alias("confidence"), null(map_type).alias("fields"), F.col("line").cast("long").alias("tie"),
    )
    pairs = F.map_filter(F.create_map(*[x for _, c in FIELDS if c != "words" for x in (F.lit(KEYS[c]), F.col(c))]), lambda _, v: readable(v))
    words = strip(F.coalesce("words", F.lit("")))
    seen = descriptions.select(
        "video_id", F.coalesce("seconds", F.lit(0.0)).alias("seconds"), F.lit("description").alias("kind"), F.when(readable(words), words).otherwise("").alias("text"), null("double").alias("end"),
        (F.when(F.col("frame") != "", F.col("frame")) if "frame" in descriptions.columns else null(text)).alias("frame"), F.when(F.col("confidence") != "", F.col("confidence")).alias("confidence"),
        F.when(F.size(pairs) > 0, pairs).alias("fields"), F.col("index").cast("long").alias("tie"),
    )
    return said.unionByName(seen)


def to_jsonl(rows: DataFrame) -> DataFrame:
    """One JSON line for each entry of `exported`, without blanks; absent keys and columns are left out."""
    for column, kind in (("frame", "string"), ("fields", "map<string,string>")):
        rows = rows if column in rows.columns else rows.withColumn(column, F.lit(None).cast(kind))
    record = F.struct(F.bround("seconds", 3).alias("t"), hms("seconds").alias("timestamp"), "kind", "text", F.when(F.col("kind") != "description", F.bround("end", 3)).alias("end"), "frame", "confidence", "fields")
    return ordered(rows, EXPORT_ORDER).select("video_id", "ordinal", F.to_json(record).alias("line"))


def _joined(lines_of: DataFrame, mark: str) -> DataFrame:
    """video_id, n, all: a video's lines in order."""
    return lines_of.groupBy("video_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda x: x["line"]), mark).alias("all"))


def _source(frame: DataFrame, names: DataFrame | None, otherwise: str) -> tuple[DataFrame, Column]:
    if names is None:
        return frame, F.lit(otherwise)
    return frame.join(names.select("video_id", F.col("name").alias("_source")), "video_id", "left"), F.coalesce("_source", F.lit(otherwise))


def to_json(rows: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One JSON document for each video: version, source (names: video_id, name), entry_count and the ordered entries."""
    j, source = _source(_joined(to_jsonl(rows), ","), names, "")
    head = F.to_json(F.struct(F.lit(1).alias("version"), source.alias("source"), F.col("n").alias("entry_count")))
    return j.select("video_id", F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"entries":['), F.col("all"), F.lit("]}")).alias("text"))


def to_markdown(rows: DataFrame) -> DataFrame:
    """One Markdown line for each entry."""
    text = F.coalesce(F.col("text"), F.lit(""))
    stamp = F.concat(F.lit("`"), hms("seconds"), F.lit("` "))
    body = (
        F.when(F.col("kind") == "silence", F.concat(F.lit("*— "), F.when(text == "", "quiet").otherwise(text), F.lit(" —*")))
        .when(F.col("kind") == "speech", text)
        .otherwise(F.concat(F.lit("**screen:** "), F.when(text == "", "(no description)").otherwise(text), F.coalesce(F.concat(F.lit(" _"), F.col("confidence"), F.lit("_")), F.lit(""))))
    )
    return ordered(rows, EXPORT_ORDER).select("video_id", "ordinal", F.concat(stamp, body).alias("line"))


def markdown_document(rows: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One Markdown text for each video: a heading (names: video_id, name) and its lines, blank lines between."""
    j, source = _source(_joined(to_markdown(rows), "\n\n"), names, "Video")
    return j.select("video_id", F.concat(F.lit("# "), source, F.lit("\n\n"), F.col("all"), F.lit("\n")).alias("text"))


def to_subtitles(rows: DataFrame, mark: str = ",") -> DataFrame:
    """Numbered cues of speech with text; a missing or too early end is two seconds on. mark "," for SRT, "." for VTT."""
    said = ordered(rows, EXPORT_ORDER).where("kind = 'speech' and text <> ''")
    end = F.when(F.coalesce(F.col("end") > F.col("seconds"), F.lit(False)), F.col("end")).otherwise(F.col("seconds") + 2.0)
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("ordinal"))
    return said.select("video_id", n.alias("number"), F.concat(subtitle_time("seconds", mark), F.lit(" --> "), subtitle_time(end, mark)).alias("span"), "text")
