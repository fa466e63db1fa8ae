"""Named queries of what services answer, of citations, and of walks, places and streams over large keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.redact import Literals
from ..operators import citation, model_output, ranks, state
from ..sources import scratch, views as V
from ..streaming import events as streams, state_machines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _js(column) -> F.Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(column.alias("x"))), r'^\{"x":(.*)\}$', 1)


def _recorded(s, d) -> DataFrame:
    """An answer to each event: a service's shape, a status, and a text that is right in four cases of twelve."""
    n = F.col("event_id")
    case, number = n % 12, n.cast("string")
    one = lambda label: F.concat(F.lit(f'{{"index": "{label}", "exact_action": ["a'), number, F.lit('", " b "], "visible_text": '), _js(F.col("props")), F.lit(', "confidence": "High"}'))
    listed = lambda *x: F.concat(F.lit("["), *[y for k, item in enumerate(x) for y in ((F.lit(", "),) if k else ()) + (item,)], F.lit("]"))
    both = listed(one("IDX 01"), one("2"))
    text = (
        F.when(case == 3, F.lit("  \n")).when(case == 4, "I can't see any {picture")
        .when(case == 5, listed(one("1"), one("idx_01"), one("2"))).when(case == 6, listed(one("1"), one("2"), one("7"))).when(case == 7, listed(one("02")))
        .when(case == 8, F.concat(F.lit("Here:\n```json\n"), listed(one("02"), one("01")), F.lit("\n```\nDone."))).when(case == 9, F.concat(F.lit('{"note": 1, "frames": '), both, F.lit("}")))
        .when(case == 10, "12").when(case == 11, listed(one("1"), F.lit('{"exact_action": "x"}'))).otherwise(both)
    )
    provider = F.element_at(F.array(*map(F.lit, ("anthropic", "google", "openai", "openai_compatible", "anthropic_compatible", "ollama_local"))), (F.floor(n / 12) % 6 + 1).cast("int"))
    used, made = number, (n % 100).cast("string")
    shape = (
        F.when(provider.startswith("anthropic"), F.concat(F.lit('{"content": [{"type": "thinking", "text": "hm"}, {"type": "text", "text": '), _js(F.col("t")), F.lit('}], "usage": {"input_tokens": '), used, F.lit(', "output_tokens": '), made, F.lit("}}")))
        .when(provider == "google", F.concat(F.lit('{"candidates": [{"content": {"parts": [{"text": '), _js(F.col("t")), F.lit('}]}}], "usageMetadata": {"promptTokenCount": '), used, F.lit(', "candidatesTokenCount": '), made, F.lit("}}")))
        .when(provider.startswith("openai"), F.concat(F.lit('{"choices": [{"message": {"role": "assistant", "content": '), _js(F.col("t")), F.lit('}}], "usage": {"prompt_tokens": '), used, F.lit(', "completion_tokens": '), made, F.lit("}}")))
        .otherwise(F.concat(F.lit('{"response": '), _js(F.col("t")), F.lit("}")))
    )
    status = F.when(case == 1, F.when(n % 24 == 1, 503).otherwise(400)).when(case == 2, F.when(n % 24 == 2, 401).otherwise(404)).otherwise(200)
    rows = V.load(s, d, "events").withColumn("t", text)
    return rows.select(number.alias("request_id"), provider.alias("provider"), F.lit("m1").alias("model_id"), status.alias("status"), shape.alias("body"))


@query
def s18_answers(s, d):
    """Recorded answers of six services: texts by their digest, tokens, problems."""
    x = model_output.answers(_recorded(s, d))
    return x.select("request_id", "provider", F.sha2("raw_text", 256).alias("sha256"), "input_tokens", "output_tokens", "problem", "transient")


@query
def e5_described(s, d):
    """Two pictures were sent for each event; what fits comes back in their order, the rest is a problem."""
    sent = V.load(s, d, "events").select(F.col("event_id").cast("string").alias("request_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("place"), F.col("event_id").alias("at"))
    sent = sent.select("request_id", "place", F.format_string("%02d", F.col("place")).alias("label"), (F.col("at") * 2.0 + F.col("place")).alias("seconds"))
    return model_output.described(model_output.answers(_recorded(s, d)), sent, ["exact_action", "visible_text", "setup_type"])


@query
def pk13_citation(s, d):
    """A time of a job as one answer: its first active video, lines nearby, the nearest picture."""
    own = lambda c: F.format_string("job %d", F.col(c) - F.when(F.col(c) % 8 == 1, 1).otherwise(0))
    jobs = V.jobs(s, d).select(F.col("job_id").cast("string").alias("job_id"), own("job_id").alias("name"))
    videos = V.job_videos(s, d).where("job_id % 7 > 0").select(F.col("job_id").cast("string").alias("job_id"), (F.col("part") % 100).alias("video_id"), F.format_string("part %d", "part").alias("name"), "sequence", "active", "seconds")
    n = F.col("c_custkey")
    requests = V.load(s, d, "customer").select(n.alias("request"), F.when(n % 3 == 0, F.concat(F.lit("job "), n.cast("string"))).when(n % 3 == 1, F.concat(n.cast("string"), F.lit("00"))).otherwise(n.cast("string")).alias("ref"), F.when(n % 10 > 0, (n % 40 * 50).cast("double")).alias("seconds"))
    t = V.transcript(s, d)
    entries = t.select("video_id", F.col("start_seconds").alias("seconds"), F.when(F.col("is_silence"), "silence").otherwise("speech").alias("kind"), "text", F.col("line").cast("long").alias("tie"))
    x = citation.cite(requests, jobs, videos, entries, V.descriptions(s, d), 30.0)
    lines = F.array_join(F.transform("lines", lambda r: F.concat_ws(" ", r["kind"], r["text"])), "\n")
    return x.select("request", "job_id", "video_id", "problem", F.size("lines").alias("n"), F.sha2(lines, 256).alias("sha256"), "picture", "picture_seconds")


@query
def x1_literals(s, d):
    """Every long word of the benchmark is a known value: masked in all documents by one automaton."""
    words = V.load(s, d, "benchmark").select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]{8,}"), F.lit(0))).alias("w")).distinct()
    known = Literals(s, [r.w for r in words.collect()])
    return V.load(s, d, "documents").select("doc_id", F.sha2(known.mask("text"), 256).alias("sha256"))


@query
def o7_last_page(s, d):
    """The pictures of all videos in one order, 120 a page: a page far behind the end is the last one."""
    x = V.descriptions(s, d).select("video_id", "index")
    return ranks.page(x, 1_000_000, 120, "video_id", "index").select("video_id", "index", F.col("rank").cast("long").alias("rank"), "page", "pages")


@query
def j16_requests(s, d):
    """Each customer asks for the sources of one job, some with one more; finished jobs answer."""
    v = V.job_videos(s, d).where("active").select("job_id", (F.col("part") % 10).alias("source"))
    jobs = v.join(V.jobs(s, d).where("status in ('completed', 'completed_with_gaps')").select("job_id", "created_at"), "job_id")
    n = F.col("c_custkey")
    asked = V.load(s, d, "customer").select(n.alias("request"), n.alias("job_id")).join(v, "job_id").select("request", "source")
    more = asked.where("request % 3 = 0").select("request", F.lit(3).cast("long").alias("source")).distinct()
    return state.same_sources_of(asked.unionByName(more), jobs)


@query
def a18_ordered(s, d):
    """The fingerprint of jobs in the order of their ids, by a tree of digests."""
    found = state.ordered_fingerprint(V.work(s, d), V.stage_runs(s, d), "worker 1", "job_id", "status", "created")
    return s.createDataFrame([(found,)], "fingerprint string")


def _stream_of(s, d) -> DataFrame:
    """The event log as a stream, half a second from one event to the next."""
    at = F.timestamp_millis((F.col("event_id") + 1) * 500)
    return streams.read(s, d, "events.parquet").withColumn("at", at)


@query
def t3_progress(s, d):
    """Three runs report twice in three seconds; what is published is two seconds apart, held-back values included."""
    rows = _stream_of(s, d).select((F.col("user_id") % 3).alias("run_id"), "at", F.floor("value").alias("done"), F.lit(None).cast("long").alias("total"), F.lit(False).alias("forced"))
    folder = scratch.new_folder(s)
    state_machines.run_batches(state_machines.progress(rows), "progress", folder)
    out = state_machines.batches(s, "progress", folder, "run_id long, what string, at timestamp, done long, total long")
    return out.select("run_id", "what", F.unix_millis("at").alias("at_ms"), "done")


@query
def t2_leases(s, d):
    """Three workers acquire, renew and release the claims of five places: what comes of each step."""
    n = F.col("event_id")
    kind = F.when(n % 4 == 0, "acquire").when(n % 4 == 3, "release").otherwise("beat")
    rows = _stream_of(s, d).select((F.col("user_id") % 5).alias("place"), F.timestamp_millis((n + 1) * 17_000).alias("at"), F.concat(F.lit("w"), (F.floor(n / 4) % 3).cast("string")).alias("worker"), kind.alias("kind"))
    folder = scratch.new_folder(s)
    state_machines.run_batches(state_machines.leases(rows), "leases", folder)
    out = state_machines.batches(s, "leases", folder, "place long, at timestamp, worker string, result string")
    return out.where("result <> 'stale'").select("place", F.unix_millis("at").alias("at_ms"), "worker", "result")


@query
def t4_refreshes(s, d):
    """Screens of all users by their last event: one row for the batch that changed them."""
    rows = _stream_of(s, d).select(F.col("user_id").alias("job_id"), "at", "event_type")
    return state_machines.refreshes(rows, "screen", scratch.new_folder(s)).select("batch", "jobs")
