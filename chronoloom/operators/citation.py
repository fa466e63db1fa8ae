"""From a moment to its evidence: containing section, lines nearby, nearest picture."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.timefmt import hms
from .timeline import EXPORT_ORDER, rank


def containing(moments: DataFrame, segments: DataFrame) -> DataFrame:
    """The section [start, end) that holds each moment, null where none does. Sections of a video
    don't overlap, so it is the last that begins by then: one window over both, no pairs."""
    rest = [c for c in moments.columns if c != "video_id"]
    s = segments.select("video_id", F.col("start").alias("_at"), F.struct("start", "end", "title").alias("_s"), F.lit(None).cast(moments.select(F.struct(*rest)).schema[0].dataType).alias("_m"))
    m = moments.select("video_id", F.col("seconds").cast("double").alias("_at"), F.lit(None).cast(s.schema["_s"].dataType).alias("_s"), F.struct(*rest).alias("_m"))
    w = Window.partitionBy("video_id").orderBy("_at", F.col("_m").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = s.unionByName(m).withColumn("_l", F.last("_s", ignorenulls=True).over(w)).where("_m is not null")
    inside = F.col("_at") < F.col("_l.end")
    return found.select("video_id", "_m.*", *[F.when(inside, F.col(f"_l.{a}")).alias(b) for a, b in (("start", "from_s"), ("end", "to_s"), ("title", "title"))])


def near(moments: DataFrame, entries: DataFrame, within: float = 15.0) -> DataFrame:
    """Entries at most `within` seconds from each moment, ends included. Both sides are
    keyed by the video and a bucket of the band's width, and a moment looks into three
    buckets: a long video spreads over many keys, and no video is compared whole."""
    bucket = lambda c: F.floor(F.col(c) / within)
    m = moments.withColumn("_b", F.explode(F.array(bucket("seconds") - 1, bucket("seconds"), bucket("seconds") + 1)))
    e = entries.withColumnRenamed("seconds", "at").withColumn("_b", F.floor(F.col("at") / within))
    return m.join(e, ["video_id", "_b"]).where(F.abs(F.col("at") - F.col("seconds")) <= within).drop("_b")


def nearest(moments: DataFrame, pictures: DataFrame) -> DataFrame:
    """The nearest picture to each moment (moment_id), the lower index on a tie."""
    # the last picture before and the first from then on, by windows over both: no pairs
    p = pictures.groupBy("video_id", F.col("seconds").alias("at")).agg(F.min("index").alias("picture"))
    p = p.select("video_id", "at", F.struct("at", "picture").alias("_p"), F.lit(None).cast(moments.schema["moment_id"].dataType).alias("moment_id"))
    m = moments.select("video_id", F.col("seconds").cast("double").alias("at"), F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), "moment_id")
    both = p.unionByName(m)
    w = Window.partitionBy("video_id").orderBy("at", F.col("_p").isNull())
    before = F.last("_p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_p", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near_two = both.withColumn("_b", before).withColumn("_a", after).where("moment_id is not null")
    off = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.at") - F.col("at")).alias("off"), F.col(f"{c}.picture").alias("picture"), F.col(f"{c}.at").alias("at")))
    best = near_two.select("moment_id", F.least(off("_b"), off("_a")).alias("b")).where("b is not null")
    return best.select("moment_id", "b.picture", "b.at", "b.off")


def nearest_on_grid(moments: DataFrame, interval: float) -> DataFrame:
    """The same on a complete grid, by arithmetic; moments has pictures (their number)."""
    i = F.ceil(F.col("seconds") / interval - 0.5)
    return moments.withColumn("picture", F.greatest(F.lit(0), F.least(i, F.col("pictures") - 1)).cast("int"))


def resolve(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Which job a reference means: its id, else the one job of exactly that name, else the one id it begins;
    problem says why there is none. requests: request, ref; jobs: job_id, name (strings)."""
    r = requests.select("request", "ref")
    by_id = r.join(jobs.select("job_id"), F.col("ref") == F.col("job_id")).select("request", F.lit(1).alias("way"), "job_id")
    by_name = r.join(jobs, F.col("ref") == F.col("name")).groupBy("request").agg(F.count("*").alias("n"), F.min("job_id").alias("job_id")).select("request", F.when(F.col("n") == 1, 2).otherwise(3).alias("way"), "job_id")
    # prefixes are looked up by equality on the prefix, one key for each length in use
    lengths = r.select(F.length("ref").alias("n")).where("n > 0").distinct()
    keyed = jobs.join(F.broadcast(lengths), F.length("job_id") > F.col("n")).select(F.expr("left(job_id, n)").alias("ref"), "job_id")
    by_start = r.join(keyed, "ref").groupBy("request").agg(F.count("*").alias("n"), F.min("job_id").alias("job_id")).select("request", F.when(F.col("n") == 1, 4).otherwise(5).alias("way"), "job_id")
    best = by_id.unionByName(by_name).unionByName(by_start).groupBy("request").agg(F.min(F.struct("way", "job_id")).alias("b"))
    return r.join(best, "request", "left").select("request", "ref", F.when(~F.col("b.way").isin(3, 5), F.col("b.job_id")).alias("job_id"), F.when(F.col("b.way").isNull(), "not found").when(F.col("b.way").isin(3, 5), "ambiguous").alias("problem"))


def cite(requests: DataFrame, jobs: DataFrame, videos: DataFrame, entries: DataFrame, pictures: DataFrame, within: float = 15.0) -> DataFrame:
    """What was there at a time of a job, as one row for each request: request, job_id, video_id (the job's first active
    video), seconds, problem, lines (at, kind and text, in order, at most `within` seconds away), picture, picture_seconds.
    A problem has no evidence: the reference is unknown or ambiguous, the job has no video, the time can't be read or is past the end.
    requests: request, ref, seconds; videos: job_id, video_id, name, sequence, active, seconds; entries:
    video_id, seconds, kind, text, tie; pictures: video_id, index, seconds."""
    if within < 0:
        raise ValueError("the window can't be negative")
    first = videos.where("active").groupBy("job_id").agg(F.min_by(F.struct("video_id", "name", F.col("seconds").alias("length")), "sequence").alias("v")).select("job_id", "v.*")
    asked = resolve(requests, jobs).drop("ref").join(requests.select("request", "seconds"), "request").join(first, "job_id", "left")
    past = F.concat(hms("seconds"), F.lit(" is past the end of "), F.col("name"), F.lit(", which runs "), hms("length"), F.lit("."))
    problem = F.coalesce("problem", F.when(F.col("video_id").isNull(), "no output").when(F.col("seconds").isNull(), "not a time").when(F.col("seconds") > F.col("length"), past))
    judged = asked.select("request", "job_id", "video_id", "seconds", problem.alias("problem"))
    moments = judged.where("problem is null").select(F.col("request").alias("moment_id"), "video_id", "seconds")
    close = near(moments, entries.select("video_id", "seconds", "kind", "text", "tie"), within) if within else moments.join(entries.select("video_id", "seconds", "kind", "text", "tie", F.col("seconds").alias("at")), ["video_id", "seconds"])
    said = close.groupBy("moment_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", rank(F.col("kind"), EXPORT_ORDER).alias("k"), "tie", "kind", "text"))), lambda x: F.struct(x["at"].alias("at"), x["kind"].alias("kind"), x["text"].alias("text"))).alias("lines"))
    seen = nearest(moments, pictures).select("moment_id", "picture", F.col("at").alias("picture_seconds"))
    out = judged.join(said.withColumnRenamed("moment_id", "request"), "request", "left").join(seen.withColumnRenamed("moment_id", "request"), "request", "left")
    return out.select("request", "job_id", "video_id", "seconds", "problem", F.when(F.col("problem").isNull(), F.coalesce("lines", F.array().cast(said.schema["lines"].dataType))).alias("lines"), "picture", "picture_seconds")
