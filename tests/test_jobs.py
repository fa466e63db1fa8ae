"""Plans, guards and choices of jobs, and the cases that the shared tables don't hold."""

import datetime

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import redact, text
from chronoloom.operators import citation, jobplan as P, packing, state
from chronoloom.sources import readers


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize("blank", [" ", "\t", "\u00a0", "\u2003", "\u3000", "\x1f", "\u0085"])
def test_secrets_behind_any_blank(spark, blank):
    m = redact.MASK
    given = [f"password{blank}={blank}hunter2222", f"api_key{blank}:{blank}abcdefgh12", f"Authorization:{blank}Bearer{blank}abcdef123456"]
    want = [f"password{blank}={blank}{m}", f"api_key{blank}:{blank}{m}", f"Authorization:{blank}{m}"]
    assert list(one(spark, *[redact.redact(F.lit(x)) for x in given])) == want


def test_texts_without_secrets_are_left_alone(spark):
    for x in ("plain words", "", "a token of thanks", "see https://host/path"):
        assert one(spark, redact.redact(F.lit(x))) == (x,)
    assert one(spark, redact.redact(F.lit(None).cast("string"))) == (None,)


def test_structures(spark):
    m = redact.MASK
    x = spark.createDataFrame([(1, ("t", 7, 9, [("password = hunter2222", None)]), {"secret": "s", "x": "fine", "cookie": None}, {"token": 5, "k": 6})], "id int, a struct<token:string,pin:int,api_key:int,deep:array<struct<note:string,cookie:string>>>, m map<string,string>, n map<string,int>")
    got = redact.redact_rows(x).first()
    assert got.id == 1 and got.a.token == m and got.a.pin == 7 and got.a.api_key == m
    assert got.a.deep[0].note == f"password = {m}" and got.a.deep[0].cookie is None
    assert got.m == {"secret": m, "x": "fine", "cookie": None} and got.n == {"token": None, "k": 6}


def test_confidence_takes_only_numbers(spark):
    given = ["nan", "0.9f", "0.9d", "0.9", "90", "inf", "1_0", ".5", "5e-1", "--1", ""]
    assert one(spark, *[text.confidence(F.lit(x)) for x in given]) == ("Low", "Low", "Low", "High", "High", "High", "Low", "Medium", "Medium", "Low", "Low")


def test_slugs(spark):
    given = ["a\tb\nc", "Sesión  1.2", "CON", "***", None, "x" * 80, "-_a_-", "日本 b", "A..B"]
    assert [r.s for r in spark.createDataFrame([(x,) for x in given], "n string").select(text.slug("n").alias("s")).collect()] == ["a-b-c", "sesion-1-2", "", "", "", "x" * 60, "a", "b", "a-b"]


def test_a_moment_outside_all_sections_stays(spark):
    s = spark.createDataFrame([(1, 10.0, 20.0, "one"), (1, 20.0, 30.0, "two")], "video_id long, start double, end double, title string")
    m = spark.createDataFrame([(1, 0, 5.0), (1, 1, 10.0), (1, 2, 20.0), (1, 3, 30.0), (2, 0, 15.0)], "video_id long, index int, seconds double")
    assert sorted((r.video_id, r["index"], r.title) for r in citation.containing(m, s).na.fill("-").collect()) == [(1, 0, "-"), (1, 1, "one"), (1, 2, "two"), (1, 3, "-"), (2, 0, "-")]


def test_transitions(spark):
    s = ("draft", "ready", "waiting_retry", "paused", "needs_attention", "pending", "completed", "cancelled", "odd")
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(s)], "k int, s string").select("k", state.pause(F.col("s")).alias("p"), state.resume(F.col("s")).alias("r"), state.cancel(F.col("s")).alias("c"), P.guarded(F.col("s"), F.lit("analyzing")).alias("g"))
    got = {s[r.k]: (r.p, r.r, r.c, r.g) for r in rows.collect()}
    assert got["waiting_retry"][0] == "paused" and got["draft"][0] == "draft" and got["needs_attention"][1] == "needs_attention"
    assert got["needs_attention"][2] == "needs_attention" and got["pending"][2] == "pending" and got["draft"][2] == got["paused"][2] == "cancelled"
    assert got["paused"][3] == "paused" and got["ready"][3] == "analyzing"


def test_creation_problems(spark):
    jobs = spark.createDataFrame([(1, " ", "none", True), (2, "n" * 121, "none", True), (3, " ok ", "google", False), (4, "many", "none", True)], "job_id long, name string, provider string, start boolean")
    listed = spark.createDataFrame([(3, ["b", "a"]), (4, ["v"] * 21)], "job_id long, paths array<string>")
    rows, videos = P.create(jobs, listed, 5.0)
    got = {r.job_id: r for r in rows.collect()}
    assert got[1].problem == "The job needs a name." and "121 characters" in got[2].problem and got[4].problem.startswith("21 videos were listed")
    assert (got[3].status, got[3].budget, got[3].name) == ("draft", 5.0, "ok")
    assert [(r.sequence, r.path) for r in videos.orderBy("sequence").collect()] == [(0, "b"), (1, "a")]


def test_probe_problems(spark):
    rows = [("1", '{"format":{"duration":"0"},"streams":[{"codec_type":"video","duration":"2.5"}]}'), ("2", '{"format":{"duration":"x"},"streams":[{"codec_type":"audio"}]}'), ("3", "no json"), ("4", '{"format":{},"streams":[{"codec_type":"video"}]}')]
    got = {r.video_id: (r.seconds, r.problem) for r in readers.probe(spark.createDataFrame(rows, "video_id string, json string")).collect()}
    assert got == {"1": (2.5, None), "2": (None, "no video stream"), "3": (None, "no video stream"), "4": (None, "no duration")}


def test_elapsed(spark):
    now = F.lit(datetime.datetime(2024, 1, 1, 0, 0, 10)).cast("timestamp")
    assert one(spark, *[P.elapsed_since(F.lit(x).cast("string"), now) for x in ("2024-01-01 00:00:04", "2024-01-01 00:00:40", "soon", None)]) == (6.0, 0.0, None, None)


def test_fingerprint_moves_with_every_part(spark):
    jobs = spark.createDataFrame([(1, "ready"), (2, "ready")], "id long, s string")
    runs = spark.createDataFrame([(1, 2)], "done long, total long")
    of = lambda j, r, w="w": state.fingerprint(j, r, w, "id", "s").first()[0]
    base = of(jobs, runs)
    assert len(base) == 16 and of(jobs.orderBy(F.desc("id")), runs) == base
    swapped = spark.createDataFrame([(1, "done"), (2, "ready")], "id long, s string")
    assert len({base, of(swapped, runs), of(jobs, runs.unionAll(runs)), of(jobs, runs, "v"), of(jobs.limit(0), runs)}) == 5


def test_packs_and_throttling_over_several_keys(spark):
    rows = spark.createDataFrame([(c, k, t) for c in "ab" for k, t in enumerate((3, 3, 9, 2, 5, 4))], "collection string, sequence long, tokens long")
    got = {(r.collection, r.sequence): (r.part, r.oversized) for r in packing.next_fit(rows, 7).collect()}
    assert [got["a", k] for k in range(6)] == [(1, False), (1, False), (2, True), (3, False), (3, False), (4, False)] and all(got["a", k] == got["b", k] for k in range(6))
    times = spark.createDataFrame([(k, float(t)) for k in (1, 2) for t in (0, 1, 2, 5, 6, 7)], "key int, at double")
    assert sorted((r.key, r.at) for r in state.throttle(times, 2.0).collect()) == [(k, t) for k in (1, 2) for t in (0.0, 2.0, 5.0, 7.0)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "job_id long, name string, status string, priority int, created long, completed long, acknowledged long")
    assert P.unseen(none).count() == P.next_job(none).count() == P.outranked(none).count() == P.dashboard(none, "x", "running").count() == 0
    assert state.queue(none.withColumnRenamed("created", "created_at")).count() == 0
    assert packing.next_fit(spark.createDataFrame([], "collection string, sequence long, tokens long"), 5).count() == 0
