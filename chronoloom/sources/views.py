"""Domain views over the shared tables: which columns stand for jobs, videos, stage
runs, picture descriptions, transcripts and path listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, status, priority, created_at."""
    o = load(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "ready").when(F.col("o_orderstatus") == "P", "completed_with_gaps").otherwise("completed")
    return o.select(F.col("o_orderkey").alias("job_id"), status.alias("status"), (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"), F.col("o_orderdate").alias("created_at"))


def job_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, sequence, version (repeats of one place in a job), part, supplier, seconds,
    shipped_at and active (the highest version)."""
    place = Window.partitionBy("l_orderkey", "l_linenumber")
    n = F.row_number().over(place.orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"))
    v = load(spark, sf_dir, "lineitem").select("*", n.alias("version"), F.count("*").over(place).alias("versions"))
    return v.select(
        F.col("l_orderkey").alias("job_id"), (F.col("l_linenumber") - 1).alias("sequence"), "version", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"),
        (F.col("l_quantity") * 60).alias("seconds"), F.col("l_shipdate").alias("shipped_at"), (F.col("version") == F.col("versions")).alias("active"),
    )


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("int")


def stage_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, stage, attempt, run_id, total, done, started_at and status."""
    e = load(spark, sf_dir, "events")
    attempt = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    status = F.when(F.col("event_id") % 3 == 0, "completed").when(F.col("event_id") % 3 == 1, "running").otherwise("pending")
    return e.select(F.col("user_id").alias("video_id"), F.col("event_type").alias("stage"), attempt.alias("attempt"), F.col("event_id").alias("run_id"), _k().alias("total"), F.floor("value").cast("int").alias("done"), F.col("ts").alias("started_at"), status.alias("status"))


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, index (from 0), seconds since the video's first picture, instrument,
    timeframe, action, states, visible, words, setup, confidence. Gaps between pictures are hours, not seconds."""
    e = load(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    micros = F.timestamp_diff("MICROSECOND", F.first("ts").over(w), F.col("ts"))
    bucket = F.floor(_k() / 25)
    return e.select(
        F.col("user_id").alias("video_id"), (F.row_number().over(w) - 1).alias("index"), F.floor(micros / 1_000_000).cast("double").alias("seconds"),
        F.when(F.col("event_type") == "error", "Unknown").otherwise(F.col("event_type")).alias("instrument"),
        F.when(bucket == 0, "Unknown").otherwise(F.concat(F.lit("tf"), bucket.cast("string"))).alias("timeframe"),
        F.when(F.col("value") > 100, F.col("props")).otherwise("Unknown").alias("action"),
        F.when(F.col("event_id") % 3 == 0, "Unknown").otherwise(F.format_string("state %d", F.col("event_id") % 11)).alias("states"), F.when(F.col("event_id") % 4 == 0, "").otherwise(F.format_string('the "%d"', F.col("event_id"))).alias("visible"),
        F.when(F.col("event_id") % 5 > 0, F.concat(F.lit(" a picture of "), F.col("event_type"), F.lit("\t"))).alias("words"), F.when(F.col("event_type") == "click", "setup").otherwise("Unknown").alias("setup"),
        F.when(F.col("value") < 100, "Low").when(F.col("value") < 250, "Medium").otherwise("High").alias("confidence"),
    )


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, line, start_seconds, end_seconds, text, is_silence: 15 characters a second."""
    c = load(spark, sf_dir, "conversations")
    length = F.length("text") / 15
    w = Window.partitionBy("conv_id").orderBy("turn")
    ends = F.bround(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0)), 3)
    return c.select(F.col("conv_id").alias("video_id"), F.col("turn").alias("line"), F.bround(ends - F.bround(length, 3), 3).alias("start_seconds"), ends.alias("end_seconds"), "text", (F.col("role") == "system").alias("is_silence"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """collection (the source), sequence by doc_id from 1, doc_id, text."""
    d = load(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("collection"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("sequence"), "doc_id", "text")


def silence_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, line_no, line: events dressed as a detector's log."""
    d = load(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    at = (F.col("event_id") / 10.0 - 3).cast("string")
    line = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("[silencedetect @ 0x1] silence_start: "), at))
        .when(F.col("event_type") == "click", F.concat(F.lit("[silencedetect @ 0x1] silence_end: "), at, F.lit(" | silence_duration: 1")))
        .otherwise("frame= 1 fps=0")
    )
    return d.select(F.col("user_id").alias("video_id"), (F.row_number().over(w)).alias("line_no"), line.alias("line"))


STATES = ("draft", "ready", "preparing", "transcribing", "analyzing", "waiting_retry", "paused", "needs_attention", "completed", "completed_with_gaps", "cancelled", "pending")
PROVIDERS = ("none", "ollama_local", "anthropic", "google", "openai_compatible", "", "elsewhere")


def _pick(values, number) -> F.Column:
    return F.element_at(F.array(*[F.lit(x) for x in values]), (number % len(values) + 1).cast("int"))


def work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs in every state, with provider, model, interval and times in seconds: job_id, name, status,
    priority, created, started, completed, acknowledged, provider, model_id, interval_ms."""
    j, n = jobs(spark, sf_dir), F.col("job_id")
    created = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("created_at").cast("timestamp_ntz"))
    return j.select(
        "job_id", F.format_string("Job %d", n).alias("name"), _pick(STATES, n).alias("status"), "priority", created.alias("created"), F.when(n % 5 > 0, created + n % 100).alias("started"),
        F.when(n % 6 > 0, created + n % 5000).alias("completed"), F.when(n % 3 == 0, created).alias("acknowledged"), _pick(PROVIDERS, n).alias("provider"), _pick(("", "m1", "m2"), n).alias("model_id"),
        F.when(n % 4 > 0, n % 4 * 2500).cast("int").alias("interval_ms"),
    )


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """batch_id, run_id (four batches to a run), pictures, status."""
    e = load(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("batch_id"), (F.col("event_id") - F.col("event_id") % 4).alias("run_id"), (F.col("event_id") % 20 + 1).cast("int").alias("pictures"), F.when(F.col("event_id") % 5 == 0, "skipped").otherwise("completed").alias("status"))


def runs_of_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stage_runs in the four stages' names, with model_id, their own duration and their video's."""
    r, n = stage_runs(spark, sf_dir), F.col("run_id")
    stage = _pick(("frames", "transcribe", "visual", "assemble"), F.col("run_id"))
    return r.select("run_id", "video_id", stage.alias("stage"), "attempt", "status", "total", "done", _pick(("m0", "m1"), F.floor(n / 4)).alias("model_id"), (n % 900 - 30).cast("double").alias("took"), (F.col("video_id") % 50 * 60).cast("double").alias("video_seconds"))
