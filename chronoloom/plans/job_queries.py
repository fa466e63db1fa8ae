"""Named queries about jobs: plans, receipts, guards, claims, orders and sources of collections.

Every query runs over whole tables; their SQL is in job_oracle."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..functions import redact as X, text as X_TEXT
from ..operators import citation, costs, jobplan as P, packing, state as state_ops, video_files
from ..sources import readers, text_files, views as V

QUERIES = {}
NOW = 1_000_000_000


def query(f):
    QUERIES[f.__name__] = f
    return f


def _videos(s, d):
    return V.job_videos(s, d).select("job_id", "sequence", "version", "seconds", "active", "part")


def _runs_of_jobs(s, d):
    """Runs dealt to jobs: job_id is the run's number."""
    return V.runs_of_videos(s, d).withColumn("job_id", F.col("run_id"))


# ------------------------------------------------------------------ predicates


@query
def p6_time_range(s, d):
    t = V.transcript(s, d).select("video_id", "line", F.col("start_seconds").alias("seconds"))
    both, late = P.between(t, 10.0, 60.0), P.between(t, start=60.0)
    return both.withColumn("kind", F.lit("both")).unionAll(late.withColumn("kind", F.lit("from"))).select("kind", "video_id", "line")


@query
def p10_interval_grid(s, d):
    x = V.load(s, d, "events").select("event_id", (F.floor("value") / F.when(F.col("event_id") % 3 == 0, 50).when(F.col("event_id") % 3 == 1, 8).otherwise(2)).alias("interval"))
    return x.select("event_id", "interval", P.interval_problem(F.col("interval")).alias("problem"))


@query
def p11_collection_numbers(s, d):
    n = F.floor("value").cast("bigint")
    limit = F.when(F.col("event_id") % 7 == 0, "many").when(F.col("event_id") % 7 == 1, F.lit(" 20000000 ")).otherwise((n * 20).cast("string"))
    reserve = F.when(F.col("event_id") % 5 == 0, F.lit("")).when(F.col("event_id") % 5 == 1, F.lit("-4")).otherwise((n * (F.col("event_id") % 30)).cast("string"))
    return V.load(s, d, "events").select("event_id", F.array_join(P.collection_problems(limit, reserve), " ").alias("problems"))


@query
def p15_next_job(s, d):
    w = V.work(s, d)
    return P.next_job(w).select("job_id", F.lit("any").alias("scope")).unionAll(P.next_job(w, 13).select("job_id", F.lit("13").alias("scope"))).unionAll(P.next_job(w, 14).select("job_id", F.lit("14").alias("scope")))


@query
def p16_unseen(s, d):
    return P.unseen(V.work(s, d)).select("job_id", "completed")


@query
def p18_within_root(s, d):
    name = F.concat(F.when(F.col("page_id") % 3 == 0, "a/../").when(F.col("page_id") % 3 == 1, "../").otherwise("/out/jobs/./"), F.when(F.col("page_id") % 2 == 0, "jobs/").otherwise("x//"), F.col("page_id").cast("string"))
    x = V.load(s, d, "pages").select("page_id", name.alias("path"))
    return x.select("page_id", "path", P.lexical(F.concat(F.lit("/"), F.col("path"))).alias("plain"), P.within("/out/jobs", F.col("path")).alias("inside"))


@query
def p21_supported(s, d):
    ext = F.element_at(F.array(*map(F.lit, (".mp4", ".MOV", ".mkv", ".webm", "", ".mp4.txt"))), (F.col("page_id") % 6 + 1).cast("int"))
    x = V.load(s, d, "pages").select("page_id", F.concat(F.lit("in/v"), F.col("page_id").cast("string"), ext).alias("path"))
    return x.select("page_id", "path", X_TEXT.supported("path").alias("supported"))


@query
def p23_budget(s, d):
    w = V.work(s, d).select("job_id", "provider", (F.col("job_id") % 90 / 10.0).alias("spent"), (F.col("job_id") % 7 / 2.0).alias("following"))
    limit = F.lit(5.0)
    return w.select("job_id", costs.applies(F.col("provider")).alias("applies"), costs.exhausted(F.col("spent"), limit, F.col("provider")).alias("exhausted"), costs.would_exceed(F.col("spent"), F.col("following"), limit, F.col("provider")).alias("would_exceed"), F.bround(costs.remaining(F.col("spent"), limit), 6).alias("remaining"))


# ------------------------------------------------------------------ joins and aggregates


@query
def j2_gaps(s, d):
    """J2, A7: pictures of skipped batches of each video, 0 where there are none."""
    r, b = V.runs_of_videos(s, d), V.batches(s, d).where("status = 'skipped'")
    gaps = r.join(b.select("run_id", "pictures"), "run_id").groupBy("video_id").agg(F.sum("pictures").alias("gaps"))
    return r.select("video_id").distinct().join(gaps, "video_id", "left").select("video_id", F.coalesce("gaps", F.lit(0)).alias("gaps"))


@query
def j10_missing_files(s, d):
    p = V.load(s, d, "pages").select(F.concat(F.lit("out/"), F.col("page_id").cast("string")).alias("path"), "page_id")
    return p.join(p.where("page_id % 4 <> 0").select("path"), "path", "left_anti").select("path")


@query
def j11_description_of(s, d):
    """The first description of each picture asked for, by video and number."""
    p = V.descriptions(s, d)
    asked = p.select("video_id", (F.col("index") * 2).alias("index"))
    twice = p.select("video_id", "index", F.col("seconds").alias("at"), "confidence").unionAll(p.select("video_id", "index", F.col("seconds") + 1, F.lit("later")))
    return P.first_match(asked, twice, ["video_id", "index"], "at", "confidence")


@query
def j14_lines_within_45(s, d):
    from .registry import _moments

    lines = V.transcript(s, d).select("video_id", F.col("start_seconds").alias("seconds"), "line")
    return citation.near(_moments(s, d), lines, 45.0).select("moment_id", "line", "at")


@query
def a4_sent(s, d):
    """Jobs and pictures that went to a service, from the work that ran."""
    r = _runs_of_jobs(s, d).where("stage = 'visual' and done > 0")
    w = V.work(s, d).where(P.leaves_machine(F.col("provider"))).select("job_id")
    return r.join(w, "job_id").agg(F.count_distinct("job_id").alias("jobs"), F.coalesce(F.sum("done"), F.lit(0)).cast("long").alias("pictures"))


@query
def a8_rate_by_model(s, d):
    r = V.runs_of_videos(s, d).withColumn("items", F.col("done"))
    return P.recent_rates(r, "items", "stage", "model_id")


@query
def a9_rate_by_video_second(s, d):
    return P.recent_rates(V.runs_of_videos(s, d), "video_seconds", "stage")


@query
def a11_versions(s, d):
    """Described pictures and those of low confidence of each version (here: instrument)."""
    p = V.descriptions(s, d)
    return p.groupBy("video_id", "instrument").agg(F.count("*").alias("described"), F.count_if(F.lower("confidence") == "low").alias("low"))


@query
def a12_job_totals(s, d):
    v = _videos(s, d).where("active").groupBy("job_id").agg(F.count("*").alias("videos"), F.sum(F.col("seconds").cast("decimal(18,2)")).cast("double").alias("seconds"), F.sum(F.ceil(F.col("seconds") / 2)).alias("pictures"))
    gaps = V.batches(s, d).where("status = 'skipped'").groupBy(F.col("run_id").alias("job_id")).agg(F.sum("pictures").alias("gaps"))
    return V.jobs(s, d).select("job_id").join(v, "job_id", "left").join(gaps, "job_id", "left").select("job_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("videos", "seconds", "pictures", "gaps")])


@query
def a14_batches(s, d):
    """Batches of 20 pictures: every video fills its own."""
    v = _videos(s, d).where("active")
    return v.groupBy("job_id").agg(F.sum(F.ceil(F.ceil(F.col("seconds") / 2) / 20)).cast("long").alias("batches"))


@query
def a15_folder_sizes(s, d):
    from .registry import _paths

    return _paths(s, d).groupBy(F.regexp_extract("path", "^(out/[^/]*)/", 1).alias("folder")).agg(F.sum("size").cast("long").alias("bytes"), F.count("*").alias("files"))


@query
def a17_benchmark(s, d):
    x = V.load(s, d, "documents").select("lang", (1 - F.length("text") / F.lit(100_000.0)).alias("saving"))
    return P.upper_median(x, "lang", "saving").select("lang", "median", "least", "most", "n")


@query
def a22_estimates(s, d):
    """Estimate of each job's stages from the measured rates, null where nothing is known."""
    r = P.recent_rates(V.runs_of_videos(s, d), "video_seconds", "stage")
    w = V.load(s, d, "nation").select(F.col("n_nationkey").alias("job_id"), (F.col("n_nationkey") * 100.0 - 300).alias("seconds"))
    return w.join(F.broadcast(r), F.lit(True)).select("job_id", "stage", P.estimate(F.col("rate"), F.col("seconds")).alias("estimate"), "samples")  # four rows of rates


@query
def pk14_plan(s, d):
    """P22, A20, PK14: what each job would involve, before it starts."""
    v = _videos(s, d).where("active").groupBy("job_id").agg(F.count("*").alias("videos"), F.sum("seconds").cast("double").alias("seconds"), F.sum(F.ceil(F.col("seconds") / 2)).alias("pictures"))
    jobs = V.work(s, d).join(v, "job_id").select("job_id", "videos", "seconds", "pictures", "provider")
    known = P.plan(jobs.where("job_id % 2 = 0"), {"frames": (0.01, 7), "transcribe": (0.25, 4), "visual": (31.0, 3)}, 5.0)
    return known.unionAll(P.plan(jobs.where("job_id % 2 = 1"), {"frames": (0.01, 7), "transcribe": (None, 1), "visual": (31.0, 3)}, 5.0))


@query
def pk15_receipt(s, d):
    """P22, PK15: what each job did, after it ran."""
    x = V.load(s, d, "documents")
    docs = x.select(F.col("doc_id").alias("job_id"), F.lit("master_assembled").alias("kind"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"))
    docs = docs.where("job_id % 2 = 0").unionAll(docs.withColumn("kind", F.lit("assembled")).withColumn("chars", F.col("chars") * 2))
    return P.receipt(V.work(s, d), _videos(s, d), _runs_of_jobs(s, d).select("job_id", "stage", "status", "done"), docs)


# ------------------------------------------------------------------ orders


@query
def w9_outranked(s, d):
    return P.outranked(V.work(s, d))


@query
def o3_transcript_order(s, d):
    """Speech before silence where both begin at once."""
    from pyspark.sql import Window

    w = Window.partitionBy("video_id").orderBy("start_seconds", "is_silence", "line")
    return V.transcript(s, d).select("video_id", "line", F.row_number().over(w).alias("place"))


@query
def o5_dashboard_orders(s, d):
    """The first 20 jobs by each sort key; an unknown one acts as the oldest."""
    j = V.work(s, d).select("job_id", "name", (F.col("created") + F.col("job_id") % 1000).alias("updated"), (F.col("job_id") % 977).alias("seconds"))
    parts = [j.orderBy(*P.dashboard_order(k)).limit(20).select("job_id", F.lit(k).alias("sort")) for k in ("recent", "oldest", "name", "longest", "upside down")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query
def o8_user_order(s, d):
    c = V.load(s, d, "conversations").select(F.col("conv_id").alias("request"), F.col("turn").alias("item"), F.col("turn").alias("place"))
    order = c.where("item % 2 = 1").select("request", "item", (-F.col("item")).alias("rank"))
    pins = c.where("item % 3 = 0").select("request", "item", (F.col("item") + 1000).alias("target"))
    return P.ordered_selection(c, order, pins)


@query
def o9_documents_of_job(s, d):
    a = _videos(s, d).select("job_id", F.when(F.col("sequence") % 3 == 0, "assembled").when(F.col("sequence") % 3 == 1, "master_assembled").otherwise("transcript").alias("kind"), (F.col("part") % 7).alias("created"), F.concat_ws("/", "job_id", "sequence", "version").alias("path"))
    return P.documents_of(a)


# ------------------------------------------------------------------ scalars


@query
def f15_elapsed(s, d):
    j = V.work(s, d)
    text = F.when(F.col("job_id") % 4 == 0, "not a time").when(F.col("job_id") % 4 == 1, F.lit(None).cast("string")).otherwise(F.date_format(F.timestamp_seconds("created"), "yyyy-MM-dd HH:mm:ss"))
    return j.select("job_id", P.elapsed_since(text, F.timestamp_seconds(F.lit(NOW))).alias("elapsed"))


@query
def f18_repair_sentence(s, d):
    n = F.col("event_id")
    counts = {"temp_files": n % 3, "missing": n % 2, "jobs": n % 5 - 3, "videos": n % 7 - 4, "runs": n % 11 - 8, "batches": n % 13 - 9}
    return V.load(s, d, "events").select("event_id", P.repair_sentence(**counts).alias("sentence"))


@query
def f23_default_names(s, d):
    ext = F.when(F.col("sequence") % 2 == 0, ".mp4").otherwise("")
    v = _videos(s, d).where("active").groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("sequence", F.concat(F.lit("in/.x y "), F.col("part").cast("string"), ext).alias("p")))).alias("l"))
    return v.select("job_id", P.default_name(F.transform("l", lambda x: x["p"])).alias("name"))


@query
def f33_schema_hashes(s, d):
    """Sixteen digits of a schema's digest: its JSON with sorted keys."""
    x = V.load(s, d, "events")
    pair = lambda k, v: F.struct(k.alias("k"), F.lit(v).alias("v"))
    schema = F.to_json(F.map_from_entries(F.array_sort(F.array(pair(F.lit("type"), "object"), pair(F.col("event_type"), "string"), pair(F.lit("additional"), "no")))))
    return x.select("event_id", X_TEXT.short_hash(schema).alias("hash"))


@query
def f35_batch_sizes(s, d):
    n = F.col("event_id")
    return V.load(s, d, "events").select("event_id", P.batch_size((n % 9 - 1).cast("int"), n % 2 == 0, n % 5 == 0).alias("size"))


@query
def f38_fallbacks(s, d):
    w, order = V.work(s, d), ["ollama_local", "anthropic", "google", "none"]
    return w.select("job_id", P.next_provider(F.col("provider"), order).alias("strict"), P.next_provider(F.col("provider"), order, True).alias("free"))


@query
def f39_backends(s, d):
    asked = F.element_at(F.array(*map(F.lit, ("auto", "cpu", "CUDA", "metal", "vulkan", "abacus", ""))), (F.col("event_id") % 7 + 1).cast("int"))
    (a, why), (b, _) = P.backend(asked, False), P.backend(asked, True)
    return V.load(s, d, "events").select("event_id", a.alias("without"), why.alias("reason"), b.alias("with_cuda"))


@query
def f41_versions(s, d):
    n = F.floor("value").cast("int").cast("string")
    text = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("ffmpeg version n"), n, F.lit(".1-static"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("ffmpeg version "), n, F.lit(".0-6ubuntu1"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("ffmpeg version git-"), n)).otherwise(n)
    return V.load(s, d, "events").select("event_id", X_TEXT.leading_version(text).alias("major"))


@query
def e8_transient(s, d):
    n = F.col("event_id") % 140 + 400
    return V.load(s, d, "events").select("event_id", n.alias("status"), n.isin(*X_TEXT.TRANSIENT_STATUS).alias("transient"))


# ------------------------------------------------------------------ collections


@query
def pk8_usable(s, d):
    w = V.work(s, d).select("job_id", F.when(F.col("job_id") % 5 > 0, F.col("job_id") % 5000).alias("limit"), F.when(F.col("job_id") % 3 > 0, F.col("job_id") % 3000).alias("reserve"))
    return w.select("job_id", P.usable_budget(F.col("limit"), F.col("reserve")).cast("long").alias("usable"))


def _assessed(s, d):
    n = F.col("job_id") + F.col("sequence") * 7
    flag = lambda k: n % k != 0
    v = _videos(s, d).where("active").join(V.work(s, d).select("job_id", "status", "created", "priority"), "job_id")
    state, detail = P.assess(flag(11), flag(7), flag(5), F.col("status"), flag(3), flag(13), ~flag(2))
    return v.select("job_id", "sequence", "priority", "created", "status", state.alias("state"), detail.alias("detail"))


@query
def pk9_assessment(s, d):
    return _assessed(s, d).select("job_id", "sequence", "state", "detail")


@query
def a19_warnings(s, d):
    return _assessed(s, d).groupBy("priority").agg(F.count_if(F.col("state") != "ok").alias("warnings"), F.count("*").alias("sources"))


@query
def s21_available(s, d):
    return _assessed(s, d).where(F.col("status").isin(*P.DONE)).select("job_id", "sequence", "state", "created")


@query
def pk6_preview(s, d):
    """What a build would give: its parts and tokens, or why there is none. Nothing is written."""
    c = packing.costs(V.documents(s, d), 120)
    reserve = F.when(F.col("collection").endswith("1"), 4000).otherwise(F.length("collection") * 300)
    budget = P.usable_budget(F.lit(4000), reserve)
    room = c.withColumn("budget", budget).where("budget > 0")
    parts = packing.next_fit(room, F.col("budget")).groupBy("collection").agg(F.max("part").cast("long").alias("parts"))
    total = c.groupBy("collection").agg(F.count("*").alias("sources"), F.sum("tokens").alias("tokens")).join(parts, "collection", "left").withColumn("budget", budget)
    return total.select("collection", "sources", "tokens", F.when(F.col("budget") > 0, F.col("parts")).alias("parts"), F.when(F.col("budget") <= 0, "The reserve leaves no room for any text.").alias("problem"))


@query
def pk16_master(s, d):
    """A job of one video needs no document over all."""
    return _videos(s, d).where("active").groupBy("job_id").agg(F.count("*").alias("videos")).select("job_id", "videos", (F.col("videos") > 1).alias("master"))


# ------------------------------------------------------------------ transitions


def _new_jobs(s, d):
    w = V.work(s, d).select("job_id", F.when(F.col("job_id") % 17 == 0, "  ").otherwise(F.col("name")).alias("name"), "provider", (F.col("job_id") % 2 == 0).alias("start"))
    v = _videos(s, d).where("active").select("job_id", F.explode(F.sequence(F.lit(1), F.when(F.col("job_id") % 19 == 0, 22).otherwise(1))).alias("k"), "sequence")
    listed = v.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sequence", "k"))), lambda x: F.concat_ws("/", x["sequence"].cast("string"), x["k"].cast("string"))).alias("paths"))
    return P.create(w, listed, 5.0)


@query
def m1_jobs_created(s, d):
    return _new_jobs(s, d)[0]


@query
def m1_videos_created(s, d):
    return _new_jobs(s, d)[1].select("job_id", "sequence", "path", "status")


@query
def m5_guarded(s, d):
    return V.work(s, d).select("job_id", P.guarded(F.col("status"), F.lit("analyzing")).alias("status"))


@query
def m7_claims(s, d):
    held = V.load(s, d, "customer").select(F.col("c_custkey").alias("root"), (F.col("c_custkey") % 5).alias("worker"), F.when(F.col("c_custkey") % 7 > 0, F.col("c_custkey") % 240).alias("age")).where("root % 3 > 0")
    asks = V.load(s, d, "customer").select(F.col("c_custkey").alias("root"), (F.col("c_custkey") % 3).alias("worker")).where("root % 4 > 0")
    return P.claim(held, asks)


@query
def m8_reruns(s, d):
    v = _videos(s, d)
    return P.rerun(v, v.where("sequence = 1").select("job_id", "sequence").distinct())


@query
def m10_delete_guards(s, d):
    w = V.work(s, d)
    cited = _videos(s, d).where("part % 50 = 0").select("job_id", F.lit(True).alias("cited")).distinct()
    return w.join(cited, "job_id", "left").select("job_id", P.delete_problem(F.col("status"), F.coalesce("cited", F.lit(False))).alias("problem"))


@query
def m11_imported(s, d):
    from .registry import _paths

    found = readers.importable(_paths(s, d))
    return P.new_folders(found, found.where("folder like '%7'"))


@query
def m12_interval_kept(s, d):
    return V.work(s, d).select("job_id", F.coalesce("interval_ms", F.lit(2000)).alias("interval_ms"))


@query
def m14_provider(s, d):
    return V.work(s, d).select("job_id", P.chosen_provider(F.col("provider"), F.lit("google")).alias("provider"), P.chosen_provider(F.col("model_id"), F.lit("m9")).alias("model"))


@query
def m15_carried(s, d):
    r = V.runs_of_videos(s, d)
    wanted = r.where("video_id % 2 = 0").select("video_id", (F.col("video_id") + 1_000_000).alias("new_id"), F.lit(3).alias("version")).distinct()
    return P.carried_stages(r.select("video_id", "stage", "status", F.col("run_id").alias("total")), wanted)


@query
def m16_acknowledged(s, d):
    return V.work(s, d).select("job_id", P.acknowledge(F.col("acknowledged"), F.col("status"), F.lit(NOW).cast("long")).alias("acknowledged"))


@query
def m17_stages_begun(s, d):
    r = V.stage_runs(s, d)
    wanted = r.select("video_id", "stage").distinct().unionAll(r.select("video_id", F.lit("assemble").alias("stage")).distinct())
    return P.begin_stages(r, wanted)


# ------------------------------------------------------------------ writers and structures


@query
def k9_transcripts(s, d):
    """The digest of each transcript's text, a line for each segment."""
    t = V.transcript(s, d)
    lines = t.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("start_seconds", "is_silence", "line", "text"))).alias("l"))
    return lines.select("video_id", F.size("l").alias("segments"), F.sha2(F.concat(F.array_join(F.transform("l", lambda x: x["text"]), "\n"), F.lit("\n")), 256).alias("sha256"))


@query
def k10_gap_files(s, d):
    """Videos with skipped pictures get a gaps file of that many; the others none."""
    b = V.batches(s, d).join(V.runs_of_videos(s, d).select("run_id", "video_id"), "run_id")
    return b.groupBy("video_id").agg(F.sum(F.when(F.col("status") == "skipped", F.col("pictures")).otherwise(0)).alias("gaps"), F.sum(F.when(F.col("status") != "skipped", F.col("pictures")).otherwise(0)).alias("described")).withColumn("file", F.when(F.col("gaps") > 0, "gaps.txt"))


@query
def k12_provenance(s, d):
    """Each job's videos with their stages, nested, as one JSON text's digest."""
    v = _videos(s, d).where("active").select("job_id", "sequence", "version")
    r = _runs_of_jobs(s, d).select("job_id", "stage", "status")
    stages = r.groupBy("job_id").agg(F.array_sort(F.collect_list(F.concat_ws(":", "stage", "status"))).alias("stages"))
    nest = v.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "version"))).alias("videos")).join(stages, "job_id")
    return nest.select("job_id", F.to_json(F.struct("job_id", "videos", "stages")).alias("json"))


@query
def k18_batch_states(s, d):
    """Rows opened and closed are appended; the last of a batch is its state."""
    b = V.batches(s, d)
    rows = b.select("batch_id", F.lit("open").alias("status"), F.lit(0).alias("at")).unionAll(b.where("batch_id % 3 > 0").select("batch_id", "status", F.lit(1)))
    return rows.groupBy("batch_id").agg(F.max_by("status", "at").alias("status"))


@query
def x2_structures(s, d):
    """Structs, maps and arrays, redacted as deep as they go; secrets after blanks of any kind."""
    n, wide = F.col("event_id").cast("string"), F.when(F.col("event_id") % 2 == 0, "\u2003").otherwise("\u00a0")
    note = F.concat(F.lit("password"), wide, F.lit("="), wide, F.lit("hunter"), n, F.lit("xxxxx end"))
    inner = F.struct(note.alias("note"), F.when(F.col("event_id") % 3 > 0, n).alias("api_key"), F.array(note, n).alias("list"))
    x = V.load(s, d, "events").select("event_id", inner.alias("inner"), F.create_map(F.lit("session_id"), n, F.lit("plain"), n).alias("m"))
    return X.redact_rows(x).select("event_id", "inner.note", "inner.api_key", F.array_join("inner.list", "|").alias("list"), F.col("m")["session_id"].alias("session"), F.col("m")["plain"].alias("plain"))



@query
def s2_probe(s, d):
    """A probe's JSON: the container's duration, else the first video stream's; 0 and less is a problem."""
    n = F.col("event_id")
    stream = F.concat(F.lit('{"streams":[{"codec_type":"audio","codec_name":"aac"},{"codec_type":"video","codec_name":"h264","width":1280,"height":720,"duration":"'), (n % 7).cast("string"), F.lit('.5"}],"format":{"format_name":"mov,mp4"'))
    raw = F.concat(stream, F.when(n % 3 > 0, F.concat(F.lit(',"duration":"'), (n % 3 - 1).cast("string"), F.lit('.0"'))).otherwise(""), F.lit("}}"))
    return readers.probe(V.load(s, d, "events").select(n.alias("video_id"), raw.alias("json")))


@query
def pk5_split_parts(s, d):
    x = packing.split_parts(V.load(s, d, "documents").select(F.col("doc_id").alias("key"), "text"), 2000, 200)
    return x.select("key", "part", "of", F.sha2("body", 256).alias("sha256"), "overlap_characters")


@query
def pk10_fits(s, d):
    state = _assessed(s, d).select("job_id", "sequence", "state").where("state <> 'gaps'")
    return state.select("job_id", "sequence", P.fit_label(F.col("state")).alias("label"))


@query
def o4_emphasis_order(s, d):
    """Pictures to look at, in order of time; those of one time in order of their number."""
    from pyspark.sql import Window

    from ..operators import enrich
    from .registry import _gaps

    e = enrich.emphasis(V.descriptions(s, d), ["instrument", "timeframe", "action"], _gaps(s, d))
    return e.select("video_id", "index", "seconds", F.row_number().over(Window.partitionBy("video_id").orderBy("seconds", "index")).alias("place"))


@query
def k11_handoff(s, d):
    from .registry import _paths

    return P.handoff(_paths(s, d).withColumn("folder", F.regexp_extract("path", "^(out/[^/]*)/", 1)), "folder")


@query
def p12_stale_claims(s, d):
    """Heartbeats as text: an unreadable or missing one is stale, one of exactly two minutes is not."""
    n = F.col("event_id")
    beat = F.when(n % 7 == 0, "soon").when(n % 7 == 1, F.lit(None).cast("string")).otherwise(F.date_format(F.timestamp_seconds(F.lit(NOW) - n % 240), "yyyy-MM-dd HH:mm:ss"))
    age = F.unix_seconds(F.timestamp_seconds(F.lit(NOW))) - F.unix_seconds(F.try_to_timestamp(beat))
    return V.load(s, d, "events").select("event_id", state_ops.stale(age).alias("stale"))


@query
def t4_refresh(s, d):
    """A screen is drawn again when a job has moved, and not when nothing has."""
    w, r = V.work(s, d), V.stage_runs(s, d)
    of = lambda jobs: state_ops.fingerprint(jobs, r, "worker 1", "job_id", "status", "created")
    later = w.withColumn("status", F.when(F.col("job_id") == 1, "cancelled").otherwise(F.col("status")))
    return P.moved(of(w), of(w)).select(F.lit("same").alias("what"), "refresh").unionAll(P.moved(of(w), of(later)).select(F.lit("moved"), "refresh"))


@query
def k9_transcript_files(s, d):
    """The digests of each video's transcript files."""
    t = V.transcript(s, d)
    n = F.col("video_id")
    videos = t.select("video_id").distinct().select("video_id", F.format_string("v%d.mp4", n).alias("filename"), F.when(n % 3 == 0, '{"backend":"cpu"}').alias("provenance"))
    return text_files.digests(video_files.transcript_lines(t, videos))


@query
def k10_gap_texts(s, d):
    """The digest of each gaps file: skipped batches' first pictures with their reasons."""
    b = V.batches(s, d).join(V.runs_of_videos(s, d).select("run_id", "video_id"), "run_id").where("status = 'skipped'")
    skips = b.select("video_id", (F.col("batch_id") * 37 % 2_000_000).alias("index"), F.when(F.col("batch_id") % 3 > 0, F.format_string("refused after %d tries", "pictures")).alias("reason"))
    return text_files.digests(video_files.gap_lines(skips))


@query
def m6_repairs(s, d):
    """Batches, runs, videos, jobs and files after a crash."""
    from .registry import _paths

    w, n = V.work(s, d), F.col("batch_id")
    batches = V.batches(s, d).select(n.alias("id"), F.when(n % 4 == 0, "running").otherwise(F.col("status")).alias("status"))
    videos = _videos(s, d).where("active").join(w.select("job_id", "status"), "job_id").select(F.concat_ws("/", F.col("job_id").cast("string"), F.col("sequence").cast("string")).alias("id"), "status")
    paths = _paths(s, d)
    return state_ops.repairs(batches, V.stage_runs(s, d).select(F.col("run_id").alias("id"), "status"), videos, w.select(F.col("job_id").alias("id"), "status"), paths, paths.where("size % 30 <> 0"))


@query
def m17_stages_finished(s, d):
    """Every second stage of a video ends, some in trouble; only a newest attempt that still runs is closed."""
    none = F.lit(None).cast("string")
    r = V.stage_runs(s, d).select("video_id", "stage", "attempt", "run_id", "status", "total", "done", F.lit(None).cast("long").alias("finished_at"), none.alias("error"))
    n = F.col("video_id")
    ended = r.where("video_id % 2 = 0").select("video_id", "stage").distinct().select(
        "video_id", "stage", F.when(n % 6 == 0, "failed").alias("status"), F.lit(100).alias("total"), F.when(n % 6 > 0, 100).alias("done"), F.lit(NOW).cast("long").alias("finished_at"), F.when(n % 6 == 0, "no room").alias("error")
    )
    return P.finish_stages(r, ended)


@query
def s21_newest_first(s, d):
    x = _assessed(s, d).withColumnRenamed("created", "updated")
    return P.available(x).select("place", "job_id", "sequence", "state", "detail", "updated")


@query
def f13_stage_screen(s, d):
    """All four stages of videos with runs in all, in some and in none."""
    r = V.runs_of_videos(s, d).where("not (video_id % 5 = 0 and stage = 'visual')")
    n = F.col("run_id")
    runs = r.select("video_id", "stage", n.alias("attempt"), "status", F.when(n % 9 > 0, F.col("total") * 7).alias("total"), "done", (n % 4 * 5).alias("skipped"), (n % 3000).cast("double").alias("age"))
    known = r.select("video_id").distinct()
    return state_ops.stage_screen(runs, known.unionByName(known.select((F.col("video_id") + 1_000_000).alias("video_id"))).select("video_id", F.when(F.col("video_id") % 3 > 0, F.col("video_id") % 2 == 0).alias("visual")))
