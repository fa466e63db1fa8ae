"""Job state: latest attempts, progress, estimates, queue order, transitions and clean-up.
Every transition is a function from state to new state; histories are appended to."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.timefmt import clock, remaining
from ..sources.scratch import written
from . import ranks
from .chains import starts

# The states of jobs by class.
FINISHED = ("completed", "completed_with_gaps", "cancelled")
RUNNING = ("preparing", "transcribing", "analyzing")
PAUSABLE = ("ready", "preparing", "transcribing", "analyzing", "waiting_retry")
RESUMABLE = ("paused",)
CANCELLABLE = ("draft", *PAUSABLE, "paused")
#: States with work ahead: they have a place in the queue.
QUEUEABLE = PAUSABLE
ATTENTION = ("needs_attention", "completed_with_gaps")
STAGES = ("frames", "transcribe", "visual", "assemble")
LABELS = {
    "draft": "Draft", "ready": "Ready to start", "preparing": "Preparing", "transcribing": "Writing the transcript", "analyzing": "Describing pictures",
    "waiting_retry": "Waiting to try again", "paused": "Paused", "needs_attention": "Needs you", "completed": "Finished",
    "completed_with_gaps": "Finished, with gaps", "cancelled": "Cancelled", "pending": "Waiting", "skipped": "Skipped",
}
STALE_SECONDS = 120
TOKENS_PER_PICTURE = 1_393


def status_label(status: Column) -> Column:
    """A known state's words; an unknown one as it is; a missing one says so."""
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.when(F.coalesce(status, F.lit("")) == "", "Unknown state").otherwise(F.coalesce(F.element_at(known, status), status))


def status_class(status: Column) -> Column:
    return F.when(status.isin(*FINISHED), "finished").when(status.isin(*RUNNING), "running").when(status.isin("needs_attention", "paused"), "attention").otherwise("waiting")


def latest(runs: DataFrame, *keys: str, by: str = "attempt") -> DataFrame:
    """The row of the highest attempt of each key (one aggregate, no window sort); of equal ones always the same."""
    rest = [c for c in runs.columns if c not in keys]
    best = runs.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(by, F.xxhash64(*rest))).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def percent(done: Column, total: Column, status: Column) -> Column:
    done, total = F.coalesce(done, F.lit(0)), F.coalesce(total, F.lit(0))
    return F.when(status.isin("completed", "completed_with_gaps"), 100.0).when(total > 0, F.least(F.lit(100.0), F.try_divide(done * 100.0, total))).otherwise(0.0)


def progress(runs: DataFrame) -> DataFrame:
    """Per video and stage: whole percent, words and whether its size is still unknown."""
    r = latest(runs, "video_id", "stage")
    total, done = F.coalesce("total", F.lit(0)), F.coalesce("done", F.lit(0))
    over = F.col("status").isin("completed", "completed_with_gaps")
    words = F.replace("status", F.lit("_"), F.lit(" "))
    detail = (
        F.when(over, "Done").when((total > 0) & (F.col("stage") == "transcribe"), F.concat(clock(done), F.lit(" of "), clock(total)))
        .when(total > 0, F.concat(F.format_number(done, 0), F.lit(" of "), F.format_number(total, 0)))
        .when(F.col("status") == "running", "Working").otherwise(F.concat(F.upper(words.substr(1, 1)), F.lower(words.substr(2, 100))))
    )
    return r.select("video_id", "stage", F.floor(percent(done, total, F.col("status"))).cast("int").alias("percent"), detail.alias("detail"), (~over & (total <= 0) & (F.col("status") == "running")).alias("indeterminate"))


#: The stages' words on a screen, in their order.
STAGE_LABELS = {"frames": "Pictures", "transcribe": "Transcript", "visual": "Descriptions", "assemble": "Put together"}


def stage_screen(runs: DataFrame, videos: DataFrame) -> DataFrame:
    """Four rows for each video, stages without a run too: video_id, place (from 1), label, percent, detail, state, eta,
    indeterminate. runs: video_id, stage, attempt, status, total, done, skipped (taken over from an earlier attempt), age
    (seconds since it began); videos: video_id, visual (false where descriptions were not asked for; null counts as asked).
    Runs of other videos or stages are in no row."""
    each = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(s).alias("stage"), F.lit(label).alias("label")) for k, (s, label) in enumerate(STAGE_LABELS.items(), 1)])
    wanted = videos.select("video_id", F.coalesce("visual", F.lit(True)).alias("_asked"), F.explode(each).alias("_s")).select("video_id", "_asked", "_s.*")
    told = progress(runs).withColumnRenamed("stage", "_stage").withColumnRenamed("video_id", "_video")
    last = latest(runs, "video_id", "stage").select(F.col("video_id").alias("_video"), F.col("stage").alias("_stage"), F.col("status").alias("_state"), "age", "done", "total", "skipped")
    x = wanted.join(told.join(last, ["_video", "_stage"]), (F.col("video_id") == F.col("_video")) & (F.col("stage") == F.col("_stage")), "left")
    none = F.col("_state").isNull()
    waits = F.when((F.col("stage") == "visual") & ~F.col("_asked"), "Not run").otherwise("Waiting")
    eta = F.when(F.col("_state") == "running", remaining("age", F.coalesce("done", F.lit(0)), "total", "skipped")).otherwise("")
    return x.select(
        "video_id", "place", "label", F.coalesce("percent", F.lit(0)).alias("percent"), F.when(none, waits).otherwise(F.col("detail")).alias("detail"), F.when(none, "ready").otherwise(F.col("_state")).alias("state"),
        eta.alias("eta"), F.coalesce("indeterminate", F.lit(False)).alias("indeterminate"),
    )


def overall(runs: DataFrame) -> DataFrame:
    """Mean percent of each video's latest attempts, halves to even. The mean of doubles that meet in any order is a hair
    beside a half now and then: ten digits bring it back."""
    r = latest(runs, "video_id", "stage")
    mean = F.avg(percent(F.col("done"), F.col("total"), F.col("status")))
    return r.groupBy("video_id").agg(F.bround(F.bround(mean, 10), 0).cast("int").alias("percent"))


def median_rate(runs: DataFrame, most: int = 20, least: int = 2) -> DataFrame:
    """Median seconds for one item of each stage's last `most` finished runs; runs without
    time or items are left out after the limit; null under `least` samples.
    runs: stage, run_id, finished_at, seconds, items."""
    w = Window.partitionBy("stage").orderBy(F.desc("finished_at"), F.desc("run_id"))
    recent = runs.withColumn("n", F.row_number().over(w)).where(f"n <= {most}").withColumn("rate", F.when((F.col("seconds") > 0) & (F.col("items") > 0), F.col("seconds") / F.col("items")))
    out = recent.groupBy("stage").agg(F.percentile("rate", F.lit(0.5)).alias("m"), F.count("rate").alias("samples"))
    return out.select("stage", F.when(F.col("samples") >= least, F.col("m")).alias("seconds_each"), "samples")


def queue(jobs: DataFrame) -> DataFrame:
    """Place of each job with work ahead: priority down, then creation, then id."""
    # a global order of the waiting jobs only, ranked by range-partitioned counts rather than one window over all
    ready = jobs.where(F.col("status").isin(*QUEUEABLE))
    order = [F.desc("priority"), "created_at", "job_id"]
    sorted_ = ready.select("job_id", "priority", "created_at").orderBy(*order).withColumn("_part", F.spark_partition_id())
    held = sorted_.groupBy("_part").agg(F.count("*").alias("n"))  # one row for each range of the sort
    start = held.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    placed = sorted_.withColumn("k", F.row_number().over(Window.partitionBy("_part").orderBy(*order))).join(F.broadcast(start), "_part")
    return placed.select("job_id", "priority", "created_at", (F.col("start") + F.col("k")).alias("place"))


def budget_cutoff(batches: DataFrame, limit: float) -> DataFrame:
    """Batches to send: the first that would pass the limit stops itself and all later ones.
    batches: video_id, batch, estimate decimal(18,6)."""
    w = Window.partitionBy("video_id").orderBy("batch")
    spent = F.sum("estimate").over(w.rowsBetween(Window.unboundedPreceding, 0))
    over = F.max((F.col("spent") > F.lit(limit).cast("decimal(18,6)")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return batches.withColumn("spent", spent).withColumn("over", over).select("video_id", "batch", "estimate", F.when(F.col("over") == 0, F.col("spent")).alias("spent"), (F.col("over") == 0).alias("sent"))


def run_next(jobs: DataFrame, chosen) -> DataFrame:
    """The chosen job, if it has work ahead, gets a priority above all others that have, unless it has it already."""
    ahead = F.col("status").isin(*QUEUEABLE)
    others = jobs.where(ahead & (F.col("job_id") != chosen)).agg(F.coalesce(F.max("priority"), F.lit(0)).alias("top"))
    lifted = F.when(ahead & (F.col("job_id") == chosen) & (F.col("priority") <= F.col("top")), F.col("top") + 1).otherwise(F.col("priority"))
    return jobs.crossJoin(F.broadcast(others)).select("job_id", "status", lifted.alias("priority"))  # one row of one number


def pause(status: Column) -> Column:
    return F.when(status.isin(*PAUSABLE), "paused").otherwise(status)


def resume(status: Column) -> Column:
    return F.when(status.isin(*RESUMABLE), "ready").otherwise(status)


def cancel(status: Column) -> Column:
    return F.when(status.isin(*CANCELLABLE), "cancelled").otherwise(status)


def settle(videos: DataFrame) -> DataFrame:
    """A job's end state from its videos': needs_attention before gaps before completed."""
    n = videos.groupBy("job_id").agg(F.count_if(F.col("status") == "needs_attention").alias("bad"), F.count_if(F.col("status") == "completed_with_gaps").alias("gaps"))
    return n.select("job_id", F.when(F.col("bad") > 0, "needs_attention").when(F.col("gaps") > 0, "completed_with_gaps").otherwise("completed").alias("status"))


def reconcile(runs: DataFrame) -> DataFrame:
    """After a crash: what was running waits again; what is finished stays."""
    return runs.withColumn("status", F.when(F.col("status") == "running", "pending").otherwise(F.col("status")))


#: What waits again after a crash, and as what: the states that count as interrupted, by kind.
INTERRUPTED = {"batch": (("running",), "pending"), "run": (("running",), "pending"), "video": (RUNNING, "pending"), "job": (RUNNING, "ready")}
RECOVERED = "Picked this back up after an interruption. Everything finished before the interruption was kept."


def repairs(batches: DataFrame, runs: DataFrame, videos: DataFrame, jobs: DataFrame, registered: DataFrame, present: DataFrame) -> DataFrame:
    """What a start after a crash changes: kind, id, was, now, event (jobs' only). The first four have id and status;
    registered and present have path, and of what is registered and not present the row goes (`now` is null). What is finished is in no
    row, so a second run over the result has none."""
    out = None
    for (kind, (states, now)), rows in zip(INTERRUPTED.items(), (batches, runs, videos, jobs), strict=True):
        event = F.lit(RECOVERED if kind == "job" else None).cast("string")
        x = rows.where(F.col("status").isin(*states)).select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), F.col("status").alias("was"), F.lit(now).alias("now"), event.alias("event"))
        out = x if out is None else out.unionByName(x)
    gone = registered.select("path").distinct().join(present.select("path"), "path", "left_anti")
    none = F.lit(None).cast("string")
    return out.unionByName(gone.select(F.lit("file").alias("kind"), F.col("path").alias("id"), F.lit("registered").alias("was"), none.alias("now"), none.alias("event")))


def repaired(rows: DataFrame, kind: str) -> DataFrame:
    """The rows of one kind after `repairs`: status as it is then."""
    states, now = INTERRUPTED[kind]
    return rows.withColumn("status", F.when(F.col("status").isin(*states), now).otherwise(F.col("status")))


def stale(heartbeat_age: Column) -> Column:
    return F.coalesce(heartbeat_age > STALE_SECONDS, F.lit(True))


def upsert(existing: DataFrame, new: DataFrame, key: str, order: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Latest row of each key by `order`, a new one before an existing one of the same order (and
    always the same of several new ones); the columns in `keep` stay as they first were."""
    rows = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in rows.columns if c not in (key, "_new", *keep)]
    place = F.struct(order, "_new", F.xxhash64(*rest))
    out = rows.groupBy(key).agg(F.max_by(F.struct(*rest), place).alias("r"), *[F.min_by(c, place).alias(c) for c in keep])
    return out.select(key, *keep, *[F.col(f"r.{c}").alias(c) for c in rest])


def duplicates(videos: DataFrame) -> DataFrame:
    """Repeats of a digest within a job (all but the first are refused) and across jobs (a warning)."""
    w = Window.partitionBy("job_id", "digest").orderBy("sequence", "version")
    owners = videos.groupBy("digest").agg((F.min("job_id") != F.max("job_id")).alias("elsewhere"))
    return videos.withColumn("refused", F.row_number().over(w) > 1).join(owners, "digest").select("job_id", "sequence", "version", "refused", "elsewhere")


def same_sources(jobs: DataFrame, wanted: list) -> DataFrame:
    """Finished jobs over exactly these sources, the newest first by created_at and id.
    jobs: job_id, created_at, source."""
    goal = F.array(*[F.lit(x) for x in sorted(set(wanted))])
    return jobs.groupBy("job_id").agg(F.max("created_at").alias("created_at"), F.array_sort(F.collect_set("source")).alias("s")).where(F.col("s") == goal).select("job_id", "created_at").orderBy(F.desc("created_at"), F.desc("job_id"))


def _sorted_sources(rows: DataFrame, key: str, *more: Column) -> DataFrame:
    """A row for each key: its sources in order, and an order-free digest of them (number and two sums of hashes)."""
    h = lambda *x: F.sum(F.xxhash64(*x).cast("decimal(38,0)"))
    return rows.groupBy(key).agg(F.count("*").alias("_n"), h("source").alias("_h1"), h("source", F.lit(1)).alias("_h2"), F.array_sort(F.collect_list("source")).alias("_all"), *more)


def same_sources_of(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """For each request the newest finished job over exactly its sources, repeated ones as often: request, job_id
    (null where there is none). Requests meet jobs by the digest of their sources, and the sources
    in order confirm it. requests: request, source; jobs: job_id, created_at, source; ties in time go to the larger job_id."""
    asked = _sorted_sources(requests, "request")
    done = _sorted_sources(jobs, "job_id", F.max("created_at").alias("created_at"))
    # of jobs over equal sources only the newest can be meant: one row for each digest and list meets the requests
    newest = done.groupBy("_n", "_h1", "_h2", "_all").agg(F.max(F.struct("created_at", "job_id")).alias("_job"))
    return asked.join(newest, ["_n", "_h1", "_h2", "_all"], "left").select("request", F.col("_job.job_id").alias("job_id"))


def saving(document_tokens: Column, pictures: Column) -> Column:
    """Share saved against sending every picture; null where nothing is saved."""
    s = 1 - F.try_divide(document_tokens, pictures * TOKENS_PER_PICTURE)
    return F.when(s > 0, s)


def throttle(events: DataFrame, gap: float) -> DataFrame:
    """key, at: the first of each key and every later one at least `gap` after the last let through.
    Each decision rests on the one before; `chains` settles them without one task that sees a whole key."""
    rows = events.where("at is not null").select("key", F.col("at").cast("double").alias("at"))
    return starts(rows, "key", ["at"], F.col("at"), F.lit(gap), sums=False).where("_start").select("key", "at")


def fingerprint(jobs: DataFrame, runs: DataFrame, worker: str, *columns: str) -> DataFrame:
    """16 hex digits that change when a screen would: the worker's key, jobs and the sums of their
    stages. Rows are hashed in parallel and add up to one number, so no task sees them all.
    jobs: columns, the first of them the id; runs: done, total."""
    row = F.xxhash64(*columns).cast("decimal(38,0)")
    own = jobs.agg(F.count("*").alias("jobs"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("sum"))
    stages = runs.agg(F.count("*").alias("n"), F.coalesce(F.sum("done"), F.lit(0)).alias("done"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    both = own.crossJoin(F.broadcast(stages))  # one row each
    return both.select(F.substring(F.sha2(F.concat_ws("|", F.lit(worker), "jobs", "sum", "n", "done", "total"), 256), 1, 16).alias("fingerprint"))


#: Rows under one node of a digest tree.
FAN = 1024


def ordered_digest(rows: DataFrame, line: Column, *order: Column | str) -> str:
    """A digest of the rows' lines in order: SHA-256 over FAN lines each, then over FAN digests each, until one is left;
    that of an empty table is that of an empty text. Nodes are cut by places in the order, so it doesn't depend on how rows are dealt."""
    level = ranks.ranked(rows.select(line.alias("_line"), *[(F.col(c) if isinstance(c, str) else c).alias(f"_o{k}") for k, c in enumerate(order)]), *[f"_o{k}" for k in range(len(order))], name="_place").select("_line", (F.col("_place") - 1).alias("_place"))
    while True:
        level = level.groupBy(F.floor(F.col("_place") / FAN).alias("_place")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_line"))), lambda x: x["_line"]), "\n"), 256).alias("_line"))
        level = written(level)
        if (nodes := level.count()) <= 1:
            return level.first()["_line"] if nodes else hashlib.sha256(b"").hexdigest()


def ordered_fingerprint(jobs: DataFrame, runs: DataFrame, worker: str, *columns: str) -> str:
    """`fingerprint` over the jobs in the order of the first column: 16 hex digits of worker, digest tree and sums of stages."""
    line = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    n, done, total = runs.agg(F.count("*"), F.coalesce(F.sum("done"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    return hashlib.sha256(f"{worker}|{ordered_digest(jobs, line, *columns)}|{n}:{done}:{total}".encode()).hexdigest()[:16]
