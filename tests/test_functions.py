"""Literal examples of the expressions and operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import redact, text, timefmt
from chronoloom.operators import citation, costs, enrich, model_output, packing, rerun, sampling, silence, state, timeline


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


@pytest.mark.parametrize(("given", "want"), [("00:00:00", 0), ("754", 754), ("12:34", 754), ("01:02:03", 3723), ("9.5", 9.5), ("", None), ("abc", None), ("1:2:3:4", None), ("-5", None), ("1:90", None), ("1:2:75", None)])
def test_parse_time(spark, given, want):
    assert one(spark, timefmt.parse_time(F.lit(given))) == (want,)


def test_labels(spark):
    lit = F.lit
    assert one(spark, timefmt.hms(lit(3723.9)), timefmt.hms_rounded(lit(2.5)), timefmt.subtitle_time(lit(1.0005)), timefmt.subtitle_time(lit(-1), "."), timefmt.clock(lit(0)), timefmt.clock(lit(4350)), timefmt.elapsed(lit(7500))) == ("01:02:03", "00:00:02", "00:00:01,000", "00:00:00.000", "—", "1:12:30", "2h 5m")
    assert one(spark, timefmt.span(lit(27_300)), timefmt.span(lit(300)), timefmt.relative(lit(9)), timefmt.relative(lit(100_000)), timefmt.byte_label(lit(1536)), timefmt.rough_duration(lit(12_600)), timefmt.picture_name(lit(3), lit(61))) == ("about 7½ hours", "5 minutes", "9 seconds ago", "yesterday", "1.5 KB", "about 3.5 hours", "000003_t000101.jpg")
    assert one(spark, timefmt.remaining(lit(1620), lit(620), lit(1488), lit(570)), timefmt.remaining(lit(40), lit(5), lit(9), lit(0)), timefmt.remaining(lit(100), lit(99), lit(100), lit(0))) == ("about 8 hours left", "", "nearly done")


@pytest.mark.parametrize(("given", "want"), [("High", "High"), ("fairly sure", "Medium"), ("0.95", "High"), ("0.6", "Medium"), ("0.2", "Low"), ("95", "High"), ("20", "Low"), ("junk", "Low"), (None, "Low")])
def test_confidence(spark, given, want):
    assert one(spark, text.confidence(F.lit(given).cast("string"))) == (want,)


def test_text(spark):
    lit = F.lit
    assert one(spark, text.token_estimate(F.length(lit("x" * 9))), text.picture_label(lit("IDX 01")), text.picture_label(lit("idx_1")), text.picture_label(lit("a")), text.stretch_title(lit("A"), lit("Unknown")), text.slug(lit("Ünï  Côde.Name!"))) == (2, "01", "01", None, "A", "uni-code-name")


def test_redaction(spark):
    m = redact.MASK
    s = F.lit("key sk-ant-abcdefgh12345 at https://u:pw@h/ Authorization: Bearer abc, password = hunter22 hidden-value")
    assert one(spark, redact.redact(s, ("hidden-value",))) == (f"key {m} at https://u:{m}@h/ Authorization: {m}, password = {m} {m}",)
    assert one(spark, *[redact.sensitive_key(F.lit(k)) for k in ("token", "token_limit", "api_key", "author", "X-Api-Key")]) == (True, False, True, False, True)
    got = spark.range(1).select(redact.redact_map(F.create_map(F.lit("password"), F.lit("x"), F.lit("note"), F.lit("fine"))).alias("m")).first().m
    assert got == {"password": m, "note": "fine"}


def windows(spark, rows, duration, padding):
    s = spark.createDataFrame([("v", float(a), float(b)) for a, b in rows], "video_id string, start double, end double")
    d = spark.createDataFrame([("v", float(duration))], "video_id string, duration double")
    return [(r.start, r.end) for r in silence.invert(s, d, padding).orderBy("start").collect()]


def test_silences(spark):
    assert windows(spark, [(2, 5), (7, 9)], 12, 0) == [(0, 2), (5, 7), (9, 12)]
    assert windows(spark, [(2, 6), (4, 8)], 12, 0) == [(0, 2), (8, 12)]
    assert windows(spark, [(0, 20)], 20, 0.25) == [] and windows(spark, [], 30, 0.25) == [(0, 30)]
    got = windows(spark, [(5, 9)], 14, 0.5)
    assert got[0][1] == 5.5 and got[1][0] == 8.5
    log = ["x silence_start: 2.05", "silence_end: 5.12 | silence_duration: 3", "silence_start: 9.4", "noise", "silence_end: 14.9 |", "silence_start: 20"]
    lines = spark.createDataFrame([("v", k, t) for k, t in enumerate(log)], "video_id string, line_no int, line string")
    parsed = silence.parse_log(lines)
    assert sorted((r.start, r.end) for r in parsed.collect()) == [(2.05, 5.12), (9.4, 14.9)]
    closed = silence.close_trailing(lines, parsed, spark.createDataFrame([("v", 30.0)], "video_id string, duration double"))
    assert (20.0, 30.0) in {(r.start, r.end) for r in closed.collect()}


@pytest.mark.parametrize(("ms", "count"), [(500, 20), (1000, 10), (2000, 5), (3000, 4), (5000, 2), (10000, 1)])
def test_grid(spark, ms, count):
    v = spark.createDataFrame([("v", 10.0)], "video_id string, seconds double")
    assert sampling.plan(v, ms).count() == count


def test_grid_has_no_drift(spark):
    v = spark.createDataFrame([("v", 7200.0)], "video_id string, seconds double")
    p = sampling.plan(v, 500)
    assert p.count() == 14_400 and p.agg(F.max("at")).first()[0] == 7199.5


def described(spark, readings, step=2.0):
    rows = [("v", k, k * step, a, b, "Unknown", "High") for k, (a, b) in enumerate(readings)]
    return spark.createDataFrame(rows, "video_id string, index int, seconds double, instrument string, timeframe string, action string, confidence string")


def test_switches(spark):
    assert [(r["index"], r.label) for r in enrich.switches(described(spark, [("A", "Unknown"), ("A", "Unknown"), ("B", "Unknown")])).collect()] == [(2, "B")]
    assert enrich.switches(described(spark, [("A", "x"), ("Unknown", "Unknown"), ("A", "x")])).count() == 0


def test_sections(spark):
    d = described(spark, [("A", "x")] * 60 + [("B", "x")] * 60)
    dur = spark.createDataFrame([("v", 240.0)], "video_id string, duration double")
    assert [(r.start, r.end, r.title) for r in enrich.segments(d, dur).orderBy("start").collect()] == [(0.0, 120.0, "A · x"), (120.0, 240.0, "B · x")]
    flick = described(spark, [("A", "x")] * 50 + [("B", "x")] * 2 + [("C", "x")] * 3 + [("D", "x")] * 95)
    out = enrich.segments(flick, spark.createDataFrame([("v", 300.0)], "video_id string, duration double")).orderBy("start").collect()
    assert len(out) == 2 and out[0].start == 0 and out[-1].end == 300 and out[0].end == out[1].start
    short_first = enrich.segments(described(spark, [("A", "x")] * 5 + [("B", "x")] * 50), spark.createDataFrame([("v", 110.0)], "video_id string, duration double")).collect()
    assert [(r.start, r.instrument) for r in short_first] == [(0.0, "B")]


def test_order_and_subtitles(spark):
    rows = spark.createDataFrame([("v", 0.0, "speech", "hi", None, None, 0), ("v", 0.0, "description", "", None, "Low", 0), ("v", 0.0, "silence", "", 2.0, None, 1), ("v", 4.0, "speech", "yo", 3.0, None, 2), ("v", 5.0, "speech", "", None, None, 3)], "video_id string, seconds double, kind string, text string, end double, confidence string, tie long")
    assert [r.kind for r in timeline.ordered(rows, timeline.EXPORT_ORDER).orderBy("ordinal").collect()][:3] == ["silence", "speech", "description"]
    assert [(r.number, r.span) for r in timeline.to_subtitles(rows).orderBy("number").collect()] == [(1, "00:00:00,000 --> 00:00:02,000"), (2, "00:00:04,000 --> 00:00:06,000")]
    assert '"end"' not in timeline.to_jsonl(rows).where("line like '%description%'").first().line


def test_nearest_picture_prefers_the_lower_index(spark):
    p = spark.createDataFrame([("v", k, k * 2.0) for k in range(3)], "video_id string, index int, seconds double")
    m = spark.createDataFrame([(1, "v", 3.0), (2, "v", 99.0), (3, "v", 0.9)], "moment_id int, video_id string, seconds double")
    assert {r.moment_id: r.picture for r in citation.nearest(m, p).collect()} == {1: 1, 2: 2, 3: 0}
    assert {r.moment_id: r.picture for r in citation.nearest_on_grid(m.withColumn("pictures", F.lit(3)), 2.0).collect()} == {1: 1, 2: 2, 3: 0}


def test_packing(spark):
    def parts(sizes, budget):
        d = spark.createDataFrame([("c", k, n) for k, n in enumerate(sizes)], "collection string, sequence int, tokens int")
        return [(r.part, r.oversized) for r in packing.next_fit(d, budget).orderBy("sequence").collect()]

    assert parts([300, 300, 300], 99_000) == [(1, False)] * 3
    assert parts([3, 3, 3, 9, 2, 2], 6) == [(1, False), (1, False), (2, False), (3, True), (4, False), (4, False)]
    with pytest.raises(ValueError):
        parts([1], 0)
    long = "".join(f"\n── part {k} ──\n" + "x" * 4000 for k in range(10))
    chunks = packing.cut_text(long, 6000)
    assert "".join(chunks) == long and all(c.startswith("\n── ") for c in chunks)
    assert "".join(packing.cut_text("y" * 5000, 1000)) == "y" * 5000
    assert packing.cut_text("ab\n\ncd", 4) == ["ab", "\n\ncd"] and packing.cut_text("abcd   ", 4) == ["abcd"]
    with pytest.raises(ValueError):
        packing.cut_text("abc", 0)


def test_progress_and_queue(spark):
    runs = spark.createDataFrame([("v", "visual", 1, 1, None, 0, "pending"), ("v", "visual", 2, 2, 100, 50, "running"), ("v", "frames", 1, 3, 10, 10, "completed")], "video_id string, stage string, attempt int, run_id long, total int, done int, status string")
    assert state.overall(runs).first().percent == 75
    assert {r.stage: (r.percent, r.detail) for r in state.progress(runs).collect()} == {"visual": (50, "50 of 100"), "frames": (100, "Done")}
    t = dt.datetime(2024, 1, 1)
    jobs = spark.createDataFrame([(1, "ready", 0, t), (2, "ready", 3, t), (3, "paused", 9, t), (4, "ready", 0, t)], "job_id long, status string, priority int, created_at timestamp")
    assert {r.job_id: r.place for r in state.queue(jobs).collect()} == {2: 1, 1: 2, 4: 3}
    assert {r.job_id: r.priority for r in state.run_next(jobs, 4).collect()}[4] == 4
    assert {r.job_id: r.priority for r in state.run_next(jobs, 2).collect()}[2] == 3
    once = state.reconcile(runs)
    assert once.collect() == state.reconcile(once).collect()


def test_rerun_scopes(spark):
    p = spark.createDataFrame([("v", k) for k in range(6)], "video_id string, index int")
    prev = spark.createDataFrame([("v", k, "Low" if k in (1, 4) else "High", "old") for k in range(6)], "video_id string, index int, confidence string, action string")
    ids = lambda df: sorted(r["index"] for r in df.collect())
    aimed = rerun.targets(p, prev, "low")
    assert ids(aimed) == [1, 4] and rerun.carried(prev, aimed).count() == 4
    assert ids(rerun.targets(p, prev.where("index in (0, 1, 2, 5)"), "missing")) == [3, 4]
    assert ids(rerun.targets(p, prev, "range", 5, 3)) == [3, 4, 5] and len(ids(rerun.targets(p, prev, "all"))) == 6
    new = prev.where("index = 1").withColumn("action", F.lit("new"))
    assert {r["index"]: r.action for r in rerun.merged(new, prev).collect()}[1] == "new"


def test_costs_and_budget(spark):
    w = spark.createDataFrame([("openai", 10), ("ollama_local", 10), ("who", 10)], "provider string, pictures int")
    got = {r.provider: (r.input_tokens, r.usd) for r in costs.estimate(w, costs.price_table(spark)).collect()}
    assert got == {"openai": (14500, 0.06825), "ollama_local": (0, None), "who": (16000, 0.128)}
    b = spark.createDataFrame([("v", k, "0.400000") for k in range(4)], "video_id string, batch int, e string").select("video_id", "batch", F.col("e").cast("decimal(18,6)").alias("estimate"))
    assert [r.sent for r in state.budget_cutoff(b, 1.0).orderBy("batch").collect()] == [True, True, False, False]


def test_model_output(spark):
    raw = ['[{"index": 1, "a": null, "confidence": "high"}]', 'Sure:\n```json\n{"frames": [{"index": "IDX 02", "a": ["x", " y "]}]}\n```', 'so {"index": 3, "a": {"k": "v"}, "confidence": 0.6} ok', "nothing here"]
    rows = model_output.normalise(spark.createDataFrame(list(enumerate(raw)), "request_id int, raw_text string"), ["a"]).collect()
    assert {r.request_id: (r.label, r.a, r.confidence) for r in rows} == {0: ("01", "Unknown", "High"), 1: ("02", "x; y", "Low"), 2: ("03", "k: v", "Medium"), 3: (None, "Unknown", "Low")}
    a = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, model_output.alignment(a("1", "2"), a("1", "1")), model_output.alignment(a("1", "2"), a("1", "9")), model_output.alignment(a("1", "2"), a("1")), model_output.alignment(a("1", "2"), a("2", "1"))) == ("duplicate", "unexpected", "missing", None)


def test_few_videos_are_dealt_out_before_their_pictures(spark):
    v = spark.range(64).selectExpr("id % 32 as k", "id").groupBy("k").agg(F.min("id").alias("video_id")).selectExpr("video_id", "3600.0 as seconds")
    p = sampling.plan(v, 2000)
    assert p.count() == 32 * 1800
    assert p.select(F.spark_partition_id()).distinct().count() > 4


def test_names_and_times_of_pictures_of_any_number(spark):
    rows = [(n, ms) for n in (0, 1, 9, 19, 20, 999_997, 999_998, 999_999, 1_234_567, 199_979, 199_980) for ms in (1, 333, 2000, 360_001)]
    found = {}
    for ms in (1, 333, 2000, 360_001):
        v = spark.createDataFrame([(n, (n + 0.5) * ms / 1000) for n, m in rows if m == ms], "video_id int, seconds double")
        for r in sampling.plan(v, ms).where("index = video_id").collect():
            found[r.video_id, ms] = (r["at"], r.name, r.batch, r.batch_id)
    for n, ms in rows:
        t = n * ms // 1000
        assert found[n, ms] == (round(n * ms / 1000, 3), f"{n + 1:06d}_t{t // 3600:02d}{t // 60 % 60:02d}{t % 60:02d}.jpg", n // 20, f"batch_{n // 20 + 1:04d}"), (n, ms)


def test_means_beside_a_half_in_any_order(spark):
    """62.5 and 67.5, whose doubles add up to a hair less or more in some orders of the stages."""
    from itertools import permutations

    runs = []
    for case, shares in enumerate([((1, 1), (11, 21), (1, 1), (11, 42), (19, 56)), ((1, 12), (5, 6), (11, 24), (1, 1), (1, 1))]):
        for k, order in enumerate(permutations(shares)):
            runs += [(f"{case}:{k}", f"s{j}", 1, t, d, "running") for j, (d, t) in enumerate(order)]
    got = state.overall(spark.createDataFrame(runs, "video_id string, stage string, attempt int, total int, done int, status string")).collect()
    assert len(got) == 240 and {(r.video_id[0], r.percent) for r in got} == {("0", 62), ("1", 68)}


def test_pictures_of_shared_batches_and_those_after_them(spark):
    """Videos that end before, at and after the last shared place: every picture once, the shared ones worked out once for all videos."""
    last = sampling.SHARED * 3
    lengths = {1: 0.5, 2: 3.0, 3: 4.0, 4: last - 1.0, 5: float(last), 6: last + 0.5, 7: last + 7.0}
    p = sampling.plan(spark.createDataFrame(list(lengths.items()), "video_id int, seconds double"), 1000, 3)
    assert p.columns == ["video_id", "index", "at", "name", "batch", "batch_id"]
    want = {(v, k, float(k), f"{k + 1:06d}_t{k // 3600:02d}{k // 60 % 60:02d}{k % 60:02d}.jpg", k // 3, f"batch_{k // 3 + 1:04d}") for v, n in lengths.items() for k in range(max(1, -int(-n // 1)))}
    got = [tuple(r) for r in p.collect()]
    assert len(got) == len(want) and set(got) == want
    few = sampling.plan(spark.createDataFrame([(1, 9.0)], "video_id int, seconds double"), 1000, 3, columns=("at",))
    assert few.columns == ["video_id", "at"] and sorted(r["at"] for r in few.collect()) == [float(k) for k in range(9)]
