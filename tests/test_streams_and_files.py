import json

from pyspark.sql import functions as F

from chronoloom.sources import readers, sinks
from chronoloom.streaming import events


def test_readers(spark, tmp_path):
    (tmp_path / "v1").mkdir()
    put = lambda name, x: (tmp_path / "v1" / name).write_text(x if isinstance(x, str) else json.dumps(x))
    put("frames.json", {"frames": [{"index": 0, "timestamp_seconds": 0.0, "extra": 1}, {"index": 1, "timestamp_seconds": 2.0}]})
    put("transcript.json", {"segments": [{"start_seconds": 0.5, "end_seconds": 1, "text": "hi"}, {"start_seconds": 2, "end_seconds": 3, "is_silence": True}]})
    put("visual.json", {"descriptions": [{"index": 0, "currency_pair": "A", "timestamp_seconds": 2.0, "visual_description": " w "}], "skips": [{"index": 1, "reason": "x", "attempts": 2}]})
    put("broken.json", "{not json")
    put("plan.json", {"indices": [1, 2]})
    put("log.txt", "a\nb\nc")
    at = lambda name: f"{tmp_path}/*/{name}"
    assert [(r.video_id, r["index"]) for r in readers.frames(spark, at("frames.json")).collect()] == [("v1", 0), ("v1", 1)]
    assert [(r.line, r.text, r.is_silence) for r in readers.transcript(spark, at("transcript.json")).collect()] == [(0, "hi", False), (1, "", True)]
    assert [(r.skipped, r.instrument) for r in readers.descriptions(spark, at("visual.json")).collect()] == [(1, "A")]
    assert readers.descriptions(spark, at("broken.json")).count() == 0
    assert readers.rerun_plans(spark, at("plan.json")).first()[1:] == ("all", 1, [1, 2], 0)
    assert [(r.line_no, r.line) for r in readers.log_lines(spark, at("log.txt")).collect()] == [(0, "a"), (1, "b"), (2, "c")]


def test_redacted_sink(spark, tmp_path):
    sinks.write_json(spark.createDataFrame([(1, "password = hunter22")], "id int, note string"), f"{tmp_path}/out")
    text = "".join(r.value for r in spark.read.text(f"{tmp_path}/out").collect())
    assert "hunter22" not in text and json.loads(text)["id"] == 1


def test_throttled_stream(spark, tmp_path):
    rows = [(k, f"2024-01-01 00:00:0{k}", 7, "view", 1.0, "{}") for k in range(6)]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double, props string")
    df.select("event_id", F.to_timestamp_ntz("t").alias("ts"), "user_id", "event_type", "value", "props").coalesce(1).write.parquet(f"{tmp_path}/in")
    out = []
    events.run_available(events.throttled(events.read(spark, f"{tmp_path}/in")), f"file://{tmp_path}", "append", lambda d: out.extend(r.event_id for r in d.collect()))
    assert sorted(out) == [0, 2, 4]
    counts = events.totals_now(events.hourly_counts(events.read(spark, f"{tmp_path}/in")), f"file://{tmp_path}")
    assert [r.n for r in counts.collect()] == [6]


def test_timeline_of_files(spark, tmp_path):
    import pytest

    for name, file, x in [("v1", "t", {"segments": [{"start_seconds": 1, "text": " a "}]}), ("v2", "t", {"segments": []}), ("v1", "d", {"descriptions": [{"index": 0, "timestamp_seconds": 2, "setup_type": "s", "clean_filename": "f.jpg"}]}), ("v2", "d", {"descriptions": [{"index": 0}]})]:
        (tmp_path / name).mkdir(exist_ok=True)
        (tmp_path / name / f"{file}.json").write_text(json.dumps(x))
    at = lambda name: f"{tmp_path}/*/{name}.json"
    show = lambda df: [(r.video_id, r.seconds, r.kind, r.text, r.end, r.frame, r.fields) for r in df.orderBy("video_id", "seconds").collect()]
    said = ("v1", 1.0, "speech", "a", 0.0, None, None)
    assert show(readers.timeline(spark, at("t"))) == [said]
    assert show(readers.timeline(spark, at("t"), at("d"))) == [said, ("v1", 2.0, "description", "", None, "f.jpg", {"setup_type": "s"}), ("v2", 0.0, "description", "", None, None, None)]
    (tmp_path / "v2" / "t.json").unlink()
    with pytest.raises(Exception, match="no transcript of video v2"):
        readers.timeline(spark, at("t"), at("d")).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.timeline(spark, at("none"))


def test_picture_listing(spark):
    names = ["000046_t000132.jpg", "a_t000001.jpg", "7_t99.jpg", "plain.jpg", "9_t000001_t000002.jpg", "000001_t000000.png"]
    found = readers.picture_listing(spark.createDataFrame([(f"x/y/{n}",) for n in names] + [("b.jpg",)], "path string"))
    want = [("", "b.jpg", 0, 0, "00:00:00"), ("x/y", "000046_t000132.jpg", 46, 92, "00:01:32"), ("x/y", "7_t99.jpg", 7, 0, "00:00:00"), ("x/y", "9_t000001_t000002.jpg", 9, 0, "00:00:00"), ("x/y", "a_t000001.jpg", 3, 1, "00:00:01"), ("x/y", "plain.jpg", 4, 0, "00:00:00")]
    assert sorted(tuple(r) for r in found.collect()) == want
