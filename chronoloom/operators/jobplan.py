"""Jobs before, while and after they run: plans and receipts, estimates, guards, claims and
choices. Functions of columns where a row decides alone, of DataFrames where rows meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import timefmt as C
from ..functions.text import token_estimate
from . import costs, ranks, state

# Names of providers, those that make no request, limits and wordings.
LABELS = {
    "ollama_local": "On this computer", "anthropic": "Claude", "google": "Google", "openai": "OpenAI",
    "openai_compatible": "Another service (OpenAI format)", "anthropic_compatible": "Another service (Claude format)",
}
STAYS_HERE = ("none", "ollama_local", "")
DONE = ("completed", "completed_with_gaps")
HALTED = ("paused", "cancelled")
SHORTEST, LONGEST, STEP = 0.5, 10.0, 0.5
LEAST_LIMIT, MOST_LIMIT = 1_000, 10_000_000
MOST_VIDEOS = 20
LONGEST_NAME = 120
BACKENDS = ("auto", "cpu", "cuda", "metal", "vulkan")
DOCUMENT_KINDS = ("master_assembled", "assembled")
RECENT, LEAST_SAMPLES = 20, 2


def provider_label(provider: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), provider), provider)


def comma(n: Column) -> Column:
    return F.format_number(n, 0)


# ------------------------------------------------------------------ what is sent, and what it takes


def leaves_machine(provider: Column) -> Column:
    """False where nothing is sent anywhere; a missing provider sends nothing."""
    return ~F.coalesce(provider, F.lit("none")).isin(*STAYS_HERE)


def will_leave(provider: Column, pictures: Column) -> Column:
    """A plan's sentence about what will be sent."""
    sent = F.concat(comma(pictures), F.lit(" still pictures will be sent to "), provider_label(provider), F.lit(". Your video and its audio are never sent."))
    here = F.lit("Nothing leaves this computer. The pictures go to the model you installed, on this machine.")
    return F.when(provider == "ollama_local", here).when(leaves_machine(provider), sent).otherwise("Nothing leaves this computer. No network request will be made.")


def has_left(provider: Column, pictures: Column) -> Column:
    """A receipt's sentence about what was sent."""
    sent = F.concat(comma(pictures), F.lit(" still pictures were sent to "), provider_label(provider), F.lit(". The video and its audio were not."))
    here = F.lit("Nothing left this computer. The pictures were described by the model you installed, here.")
    return F.when(provider == "ollama_local", here).when(leaves_machine(provider), sent).otherwise("Nothing left this computer. No network request was made.")


def recent_rates(runs: DataFrame, per: str, *keys: str) -> DataFrame:
    """Of each key's last 20 finished runs the median seconds for one `per` (null under two
    samples) and the samples. Runs without time or items drop out after the limit.
    runs: keys, run_id, status, took (seconds), per."""
    last = Window.partitionBy(*keys).orderBy(F.desc("run_id"))
    done = runs.where(F.col("status").isin(*DONE) & F.col("took").isNotNull() & (F.col(per) > 0))
    near = done.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= RECENT)
    rate = F.when((F.col("took") > 0) & (F.col(per) > 0), F.col("took") / F.col(per))
    out = near.groupBy(*keys).agg(F.percentile(rate, F.lit(0.5)).alias("m"), F.count(rate).alias("samples"))
    return out.select(*keys, F.when(F.col("samples") >= LEAST_SAMPLES, F.col("m")).alias("rate"), "samples")


def estimate(rate: Column, amount: Column) -> Column:
    """Seconds; null where the rate is unknown or there is nothing to do."""
    return F.when(amount > 0, rate * amount)


def plan(jobs: DataFrame, rates: dict[str, tuple[float | None, int]], limit: float) -> DataFrame:
    """What each job would involve. jobs: job_id, videos, seconds, pictures, provider. rates: of
    frames and visual for a picture, of transcribe for a second of video, with samples. One
    unknown stage makes the whole time unknown."""
    described = F.coalesce("provider", F.lit("none")) != "none"
    of = lambda stage, amount: (estimate(F.lit(rates[stage][0]).cast("double"), F.col(amount)), F.lit(rates[stage][1]))
    parts = [of("frames", "pictures"), of("transcribe", "seconds"), tuple(F.when(described, x).otherwise(F.lit(0)) for x in of("visual", "pictures"))]
    whole = parts[0][0] + parts[1][0] + parts[2][0]
    samples = F.when(whole.isNotNull(), F.least(*[n for _, n in parts])).otherwise(0)
    usd = costs.estimate(jobs.select("job_id", "provider", "pictures"), costs.price_table(jobs.sparkSession)).select("job_id", "usd")
    out = jobs.join(usd, "job_id").withColumn("leaves_anything", leaves_machine(F.col("provider")))
    return out.select(
        "job_id", "videos", "pictures", will_leave(F.col("provider"), F.col("pictures")).alias("leaves"), "leaves_anything", whole.alias("seconds_left"), samples.cast("int").alias("samples"),
        F.when(F.col("leaves_anything"), F.col("usd")).alias("usd"), F.when(F.col("leaves_anything"), F.lit(limit)).alias("budget"),
    )


def receipt(jobs: DataFrame, videos: DataFrame, runs: DataFrame, documents: DataFrame) -> DataFrame:
    """What each job did, from what it recorded. videos: job_id, seconds, active; runs: job_id,
    stage, status, done; documents: job_id, kind, chars, bytes."""
    v = videos.where("active").groupBy("job_id").agg(F.count("*").alias("videos"), F.sum(F.coalesce("seconds", F.lit(0))).alias("seconds"))
    done = lambda stage: F.coalesce(F.sum(F.when(F.col("stage") == stage, F.col("done"))), F.lit(0)).alias(stage)
    r = runs.where(F.col("status").isin(*DONE)).groupBy("job_id").agg(done("visual"), done("frames"))
    # kinds go by name, so a single video's document is measured where there is one; the shortest on a tie
    doc = documents.where(F.col("kind").isin(*DOCUMENT_KINDS)).groupBy("job_id").agg(F.min_by(F.struct("chars", "bytes"), F.struct("kind", "chars")).alias("doc"))
    x = jobs.join(v, "job_id", "left").join(r, "job_id", "left").join(doc, "job_id", "left")
    provider, described, n = F.coalesce("provider", F.lit("none")), F.coalesce("visual", F.lit(0)), F.coalesce("frames", F.lit(0))
    tokens, against = F.when(F.col("doc.chars").isNotNull(), token_estimate(F.col("doc.chars"))), F.when(n > 0, n * state.TOKENS_PER_PICTURE)
    t, none = F.floor(F.col("seconds")), provider.isin("none", "")
    service = F.concat_ws(" · ", provider_label(provider), F.nullif(F.trim("model_id"), F.lit("")))
    return x.select(
        "job_id", F.coalesce("videos", F.lit(0)).alias("videos"),
        F.when(F.col("seconds") > 0, F.format_string("%d:%02d:%02d", F.floor(t / 3600), F.floor(t / 60) % 60, t % 60)).alias("length"),
        F.when(F.col("interval_ms") > 0, F.concat(F.lit("a picture every "), F.regexp_replace((F.col("interval_ms") / 1000).cast("string"), r"\.0$", ""), F.lit(" seconds"))).alias("interval"),
        F.when(none, "not described").otherwise(F.concat(comma(described), F.lit(" pictures described"))).alias("described"),
        F.when(~none, service).alias("described_by"), has_left(provider, described).alias("left_machine"), leaves_machine(provider).alias("anything_left"),
        (F.col("completed") - F.col("started")).alias("took"), tokens.alias("tokens"), F.when(tokens > 0, against).alias("pictures_tokens"),
        F.when((tokens > 0) & (against > tokens), F.concat(F.bround((1 - tokens / against) * 100, 0).cast("int").cast("string"), F.lit("%"))).alias("saving"),
    )


def upper_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The upper of the two middle values (no mean of both), the least and the largest of each key: the
    value of a place in the order, which no task needs to see whole."""
    middle = ranks.at_rank(rows, value, F.floor(F.col("_count") / 2) + 1, key).withColumnsRenamed({key: "_k", value: "median"})
    out = rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.count("*").alias("n"))
    return out.join(middle, out[key].eqNullSafe(middle["_k"])).select(key, "median", "least", "most", "n")


# ------------------------------------------------------------------ checks of what is asked for


def interval_problem(seconds: Column) -> Column:
    """Null for a multiple of half a second from 0.5 to 10, else what is wrong."""
    steps = seconds / STEP
    return F.when(seconds.isNull() | ~seconds.between(SHORTEST, LONGEST), "out of range").when(F.abs(steps - F.rint(steps)) > 1e-9, "off the grid")


def whole_number(raw: Column, fallback: int = -1) -> Column:
    t = F.trim(raw)
    return F.coalesce(F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint")), F.lit(fallback))


def collection_problems(raw_limit: Column, raw_reserve: Column) -> Column:
    """Problems with a token limit and a reserve, as an array of sentences."""
    limit, reserve = whole_number(raw_limit), whole_number(raw_reserve)
    a = F.when(limit < 0, "The token limit must be a whole number.").when(~limit.between(LEAST_LIMIT, MOST_LIMIT), f"The token limit must be between {LEAST_LIMIT:,} and {MOST_LIMIT:,}.")
    room = F.concat(F.lit("The reserve ("), comma(reserve), F.lit(") leaves no room inside the limit ("), comma(limit), F.lit("). Lower the reserve, or raise the limit."))
    b = F.when(reserve < 0, "The reserve must be a whole number, and cannot be negative.").when((limit >= 0) & (reserve >= limit), room)
    return F.array_compact(F.array(a, b))


def usable_budget(limit: Column, reserve: Column) -> Column:
    return F.when(limit.isNull(), 0).otherwise(F.greatest(F.lit(0), limit - F.coalesce(reserve, F.lit(0))))


def lexical(path: Column) -> Column:
    """A path without empty parts, `.` and `..` (which can't leave the root of the file system)."""
    step = lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x))
    kept = F.aggregate(F.filter(F.split(path, "/"), lambda x: ~x.isin("", ".")), F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def within(root: str, path: Column) -> Column:
    """True for paths under `root`, relative ones read from there; links aren't followed."""
    full = lexical(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root + "/"), path)))
    return (full == root) | full.startswith(root + "/")


def batch_size(requested: Column, preflight_passed: Column, advanced: Column) -> Column:
    return F.when(requested < 1, 1).when(advanced, F.least(requested, F.lit(4))).when(preflight_passed, F.least(requested, F.lit(2))).otherwise(1)


def backend(requested: Column, cuda: bool) -> tuple[Column, Column]:
    """(the device, why it isn't the one asked for)."""
    r = F.lower(F.coalesce(F.nullif(requested, F.lit("")), F.lit("auto")))
    on_cuda = r.isin("auto", "cuda") & F.lit(cuda)
    why = (
        F.when(~r.isin(*BACKENDS), F.concat(F.lit("unknown backend '"), r, F.lit("'; used the processor")))
        .when((r == "cuda") & ~on_cuda, "no CUDA device was available, so the processor was used instead")
        .when(r.isin("metal", "vulkan"), F.concat(r, F.lit(" acceleration is not available for transcription; the processor was used instead")))
    )
    return F.when(on_cuda, "cuda").otherwise("cpu"), why


def next_provider(current: Column, order: list[str], local_to_cloud: bool = False) -> Column:
    """The provider to try after this one; null at the end, for one not listed, and where it
    would move work off this computer without leave."""
    names = F.array(*[F.lit(x) for x in order])
    following = F.try_element_at(names, F.array_position(names, current).cast("int") + 1)
    known = F.array_position(names, current) > 0
    return F.when(known & (F.lit(local_to_cloud) | ~current.isin(*costs.FREE) | following.isin(*costs.FREE)), following)


# ------------------------------------------------------------------ lists and orders


def dashboard(jobs: DataFrame, search: str = "", bucket: str = "") -> DataFrame:
    """Jobs whose name holds the search, in any letter case, in one bucket (any other name: all)."""
    buckets = {"running": state.RUNNING, "attention": state.ATTENTION, "finished": state.FINISHED}
    found = jobs.where(F.contains(F.lower("name"), F.lit(search.strip().lower())))
    return found.where(F.col("status").isin(*buckets[bucket])) if bucket in buckets else found


def dashboard_order(sort: str) -> list[Column]:
    """Sort keys by name; unknown names act as the oldest first. Ids settle ties."""
    keys = {"recent": F.desc("updated"), "name": F.asc(F.lower("name")), "longest": F.desc("seconds")}
    return [keys.get(sort, F.asc("updated")), F.asc("job_id")]


def unseen(jobs: DataFrame, most: int = 5) -> DataFrame:
    """Finished jobs that nobody has seen, the newest first."""
    return jobs.where(F.col("acknowledged").isNull() & F.col("status").isin(*DONE)).orderBy(F.desc_nulls_last("completed"), "job_id").limit(most)


def next_job(jobs: DataFrame, only=None) -> DataFrame:
    """The job a worker takes: the one it is told to, if it is ready, else the first that is."""
    ready = jobs.where("status = 'ready'")
    return ready.where(F.col("job_id") == only) if only is not None else ready.orderBy(F.desc("priority"), "created", "job_id").limit(1)


def outranked(jobs: DataFrame) -> DataFrame:
    """For each job under way the ready job of strictly higher priority that goes first, or null."""
    best = jobs.where("status = 'ready'").agg(F.min_by(F.struct("job_id", "priority"), F.struct(-F.col("priority"), "created", "job_id")).alias("b"))  # one row
    running = jobs.where(F.col("status").isin(*state.RUNNING))
    return running.crossJoin(F.broadcast(best)).select("job_id", F.when(F.col("b.priority") > F.col("priority"), F.col("b.job_id")).alias("by"))


def ordered_selection(picked: DataFrame, order: DataFrame, pins: DataFrame) -> DataFrame:
    """picked (request, item, place) first as listed in order (request, item, rank), the rest as
    they were picked; pins (request, item, target) name another version of an item."""
    o = order.groupBy("request", "item").agg(F.min("rank").alias("rank"))
    p = pins.groupBy("request", "item").agg(F.max("target").alias("target"))
    x = picked.join(o, ["request", "item"], "left").join(p, ["request", "item"], "left")
    n = F.row_number().over(Window.partitionBy("request").orderBy(F.asc_nulls_last("rank"), "place"))
    return x.select("request", n.alias("n"), F.coalesce("target", "item").alias("item"))


def documents_of(artifacts: DataFrame) -> DataFrame:
    """Documents of each job: the master first, then those of its videos, each by creation."""
    rank = F.array_position(F.array(*[F.lit(x) for x in DOCUMENT_KINDS]), F.col("kind"))
    n = F.row_number().over(Window.partitionBy("job_id").orderBy(rank, "created", "path"))
    return artifacts.where(rank > 0).select("job_id", n.alias("n"), "path")


def default_name(paths: Column) -> Column:
    """The first file's stem, and how many more there are."""
    name = F.element_at(F.split(paths[0], "/"), -1)
    stem = F.trim(F.regexp_replace(name, r"(?<=.)\.[^.]+$", ""))
    first = F.when(stem == "", name).otherwise(stem)
    return F.when(F.coalesce(F.size(paths), F.lit(0)) < 1, "Untitled job").when(F.size(paths) > 1, F.concat(first, F.lit(" +"), (F.size(paths) - 1).cast("string"))).otherwise(first)


def first_match(rows: DataFrame, found: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """rows with `value` of the first of found's rows by `order` with the same keys, or null."""
    return rows.join(found.groupBy(*keys).agg(F.min_by(value, order).alias(value)), keys, "left")


def between(rows: DataFrame, start: float | None = None, end: float | None = None) -> DataFrame:
    """Rows whose seconds lie from start to end, both included; either may be missing."""
    x = rows if start is None else rows.where(F.col("seconds") >= start)
    return x if end is None else x.where(F.col("seconds") <= end)


# ------------------------------------------------------------------ changes of state


def create(jobs: DataFrame, listed: DataFrame, hard_limit: float) -> tuple[DataFrame, DataFrame]:
    """New jobs and their videos, in the order listed. jobs: job_id, name, provider, start;
    listed: job_id, paths. Problems: no name, a name beyond 120 characters, too many videos."""
    x = jobs.join(listed, "job_id", "left").withColumn("name", F.trim("name"))
    size = F.length("name")
    long_name = F.concat(F.lit("That name is "), size.cast("string"), F.lit(f" characters. Keep it to {LONGEST_NAME} or fewer so it stays readable in the list and in the browser tab."))
    problem = F.when(F.col("name") == "", "The job needs a name.").when(size > LONGEST_NAME, long_name).when(F.coalesce(F.size("paths"), F.lit(0)) > MOST_VIDEOS, F.concat(F.size("paths").cast("string"), F.lit(f" videos were listed, which is more than the {MOST_VIDEOS} a single job takes.")))
    x = x.withColumn("problem", problem)
    rows = x.select("job_id", "name", F.when(F.col("problem").isNull(), F.when(F.col("start"), "ready").otherwise("draft")).alias("status"), F.when(F.col("problem").isNull() & ~F.col("provider").isin("none", "ollama_local"), F.lit(hard_limit)).alias("budget"), "problem")
    videos = x.where("problem is null").select("job_id", F.posexplode("paths").alias("sequence", "path")).withColumn("status", F.lit("pending"))
    return rows, videos


def guarded(status: Column, new: Column) -> Column:
    """A worker's write of a state: what the user has stopped stays stopped."""
    return F.when(status.isin(*HALTED), status).otherwise(new)


def claim(held: DataFrame, wanted: DataFrame) -> DataFrame:
    """Who owns each output root: the holder while its heartbeat is fresh (age in seconds, null
    for an unreadable one), else who asks. held: root, worker, age; wanted: root, worker."""
    x = wanted.withColumnRenamed("worker", "asks").join(held, "root", "full")
    taken = F.col("asks").isNotNull() & (F.col("worker").isNull() | (F.col("worker") == F.col("asks")) | state.stale(F.col("age")))
    return x.select("root", F.when(taken, F.col("asks")).otherwise(F.col("worker")).alias("owner"), (F.col("asks").isNotNull() & ~taken).alias("refused"), (taken & F.col("worker").isNotNull() & (F.col("worker") != F.col("asks"))).alias("taken_over"))


def rerun(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """A new active version for each wanted (job_id, sequence): one above the highest; all others of the place rest."""
    new = versions.join(wanted, ["job_id", "sequence"], "left_semi").groupBy("job_id", "sequence").agg((F.max("version") + 1).alias("version")).withColumn("active", F.lit(True))
    old = versions.join(wanted.select("job_id", "sequence", F.lit(True).alias("_w")), ["job_id", "sequence"], "left")
    return old.select("job_id", "sequence", "version", (F.col("active") & F.col("_w").isNull()).alias("active")).unionByName(new)


def carried_stages(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stage rows of a new version that are taken over as they are, with where they come from.
    runs: video_id, stage, status, total; wanted: video_id, new_id, version."""
    return runs.where(F.col("status").isin(*DONE)).join(wanted, "video_id").select(F.col("new_id").alias("video_id"), "stage", F.lit(1).alias("attempt"), F.lit("completed").alias("status"), "total", F.col("version").alias("carried_from"))


def begin_stages(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """A running row of the next attempt for each wanted (video_id, stage)."""
    last = runs.groupBy("video_id", "stage").agg(F.max("attempt").alias("m"))
    return wanted.join(last, ["video_id", "stage"], "left").select("video_id", "stage", (F.coalesce("m", F.lit(0)) + 1).alias("attempt"), F.lit("running").alias("status"))


def finish_stages(runs: DataFrame, ended: DataFrame) -> DataFrame:
    """runs with the stages that ended closed: status (completed where none is told), total, done (0 where none is told),
    finished_at and error of the newest attempt of each (video_id, stage), if it is still running. runs: video_id,
    stage, attempt, status, total, done, finished_at, error; ended: video_id, stage, status, total, done, finished_at, error, one row a stage."""
    last = runs.groupBy("video_id", "stage").agg(F.max("attempt").alias("attempt"))
    end = ended.select("video_id", "stage", F.struct(F.coalesce("status", F.lit("completed")).alias("status"), "total", F.coalesce("done", F.lit(0)).alias("done"), "finished_at", "error").alias("_end")).join(last, ["video_id", "stage"])
    x = runs.join(end, ["video_id", "stage", "attempt"], "left")
    closes = F.col("_end").isNotNull() & (F.col("status") == "running")
    new = {c: F.when(closes, F.col(f"_end.{c}")).otherwise(F.col(c)) for c in ("total", "done", "finished_at", "error", "status")}
    return x.withColumns(new).drop("_end")


def available(assessed: DataFrame) -> DataFrame:
    """Finished videos' sources, place 1 the one updated last; ties by job_id and sequence.
    assessed: job_id, sequence, status, updated and what `assess` found."""
    from . import ranks

    return ranks.ranked(assessed.where(F.col("status").isin(*DONE)), F.desc_nulls_last("updated"), "job_id", "sequence", name="place")


def delete_problem(status: Column, cited: Column) -> Column:
    return F.when(status.isin(*state.RUNNING), "in flight").when(cited, "cited by a collection")


def chosen_provider(own: Column, general: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(own), F.lit("")), general)


def acknowledge(acknowledged: Column, status: Column, now: Column) -> Column:
    return F.when(acknowledged.isNull() & status.isin(*DONE), now).otherwise(acknowledged)


def new_folders(found: DataFrame, known: DataFrame) -> DataFrame:
    """Folders that aren't known yet, numbered in order of their names; none, and there is no job."""
    x = found.select("folder").distinct().join(known.select("folder"), "folder", "left_anti")
    ranged = x.repartitionByRange("folder").sortWithinPartitions("folder").withColumn("_p", F.spark_partition_id())
    held = ranged.groupBy("_p").agg(F.count("*").alias("n"))
    start = held.select("_p", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s"))
    return ranged.withColumn("k", F.row_number().over(Window.partitionBy("_p").orderBy("folder"))).join(F.broadcast(start), "_p").select("folder", (F.col("s") + F.col("k") - 1).alias("sequence"))


REPAIRS = (
    ("temp_files", "interrupted write(s) cleaned up"), ("missing", "missing artifact(s) de-registered"), ("jobs", "job(s) returned to a resumable state"),
    ("videos", "video(s) returned to a resumable state"), ("runs", "stage run(s) reset"), ("batches", "unfinished batch(es) reset"),
)


def repair_sentence(**counts: Column) -> Column:
    """What a reconciliation has done, in one sentence."""
    parts = F.array_compact(F.array(*[F.when(counts[k] > 0, F.concat(counts[k].cast("string"), F.lit(" " + words))) for k, words in REPAIRS if k in counts]))
    return F.when(F.size(parts) == 0, "State and artifacts agree; nothing to repair.").otherwise(F.concat(F.array_join(parts, "; "), F.lit(".")))


# ------------------------------------------------------------------ sources of collections


def assess(folder: Column, document: Column, pictures: Column, status: Column, described: Column, readable: Column, older: Column) -> tuple[Column, Column]:
    """(state, detail) of a source; the first of these that holds. All flags but status are booleans."""
    chain = (
        (~folder, "missing_artifacts", "the folder holding this video's output could not be found."),
        (~document, "missing_artifacts", "this video has no assembled document."),
        (~pictures, "missing_artifacts", "the pictures are missing. The text is fine and can still be used."),
        (status == "completed_with_gaps", "gaps", "some pictures in this video have no description."),
        (~described, "no_visual", "this video has no descriptions — pictures and words only."),
        (~readable, "missing_artifacts", "the descriptions could not be read."),
        (older, "provenance_mismatch", "described with older wording, so it reads a little differently from the others."),
    )
    pick = lambda k, end: F.coalesce(*[F.when(c[0], c[k]) for c in chain], end)
    return pick(1, F.lit("ok")), pick(2, F.lit(""))


# How a source fits, in words.
FITS = {"ok": "Fits with the rest", "no_visual": "No descriptions", "provenance_mismatch": "Older wording", "missing_artifacts": "Pictures missing"}


def fit_label(compatibility: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in FITS.items() for x in pair]), compatibility)


def handoff(files: DataFrame, key: str) -> DataFrame:
    """Totals of what a handoff package holds: pictures, documents, files and bytes of each key."""
    n = lambda end: F.count_if(F.col("path").endswith(end))
    return files.groupBy(key).agg(n(".jpg").alias("pictures"), n(".txt").alias("documents"), F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"))


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: whether a screen has to be drawn again, by its fingerprints (one row each)."""
    return before.select(F.col("fingerprint").alias("a")).crossJoin(F.broadcast(after.select(F.col("fingerprint").alias("b")))).select((F.col("a") != F.col("b")).alias("refresh"))


def elapsed_since(text: Column, now: Column) -> Column:
    """Seconds from a timestamp in text to now, not under 0; null where it can't be read."""
    then = F.try_to_timestamp(text)
    return F.when(then.isNotNull(), F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(then)) / 1e6))


def took_label(seconds: Column) -> Column:
    return C.rough_duration(seconds)
