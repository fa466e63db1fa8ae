"""Transcript and gaps files, repairs after a crash, finished stages and the order of sources, held against plain Python."""

import json
import os

from chronoloom.operators import jobplan, state, video_files
from chronoloom.sources import text_files

SAID = "video_id long, line int, start_seconds double, end_seconds double, text string, is_silence boolean"


def read(path, name):
    return open(os.path.join(path, name), encoding="utf-8").read()


def test_transcript_files(spark, tmp_path):
    rows = [(1, 2, 3661.9, 3700.0, 'say "é"\n', False), (1, 1, 0.0, 2.0, "", True), (1, 0, 0.0, 1.5, "first", False), (1, 0, 0.0, 1.5, "first", False), (1, 3, 4000.0, 4001.0, None, False), (9, 0, 0.0, 1.0, "unknown video", False)]
    videos = spark.createDataFrame([(1, 'a"b.mp4', '{"backend":"x"}'), (2, None, None)], "video_id long, filename string, provenance string")
    lines = video_files.transcript_lines(spark.createDataFrame(rows, SAID), videos)
    text_files.write_texts(lines, f"{tmp_path}/t")
    assert sorted(os.listdir(f"{tmp_path}/t")) == ["1", "2", "_COMPLETE"]
    one = json.loads(read(f"{tmp_path}/t", "1/transcript.json"))
    label = lambda x: f"{int(x) // 3600:02d}:{int(x) // 60 % 60:02d}:{int(x) % 60:02d}"
    want = [{"start_seconds": a, "end_seconds": b, "timestamp": label(a), "text": t or "", "is_silence": q} for _, _, a, b, t, q in sorted(rows[:5], key=lambda r: (r[2], r[5], r[1]))]
    assert one == {"version": 1, "source_filename": 'a"b.mp4', "provenance": {"backend": "x"}, "segment_count": 5, "segments": want}
    assert read(f"{tmp_path}/t", "1/transcript.txt") == "".join(f"{s['timestamp']}  {s['text']}\n" for s in want)
    assert json.loads(read(f"{tmp_path}/t", "2/transcript.json")) == {"version": 1, "source_filename": "", "provenance": {}, "segment_count": 0, "segments": []}
    assert read(f"{tmp_path}/t", "2/transcript.txt") == "\n"


def test_gaps_file(spark, tmp_path):
    skips = [(1, 11, "refused"), (1, 0, None), (1, 11, "again"), (1, 1_999_999, "x" * 5000), (2, 4, "one")]
    lines = video_files.gap_lines(spark.createDataFrame(skips, "video_id long, index long, reason string"))
    text_files.write_texts(lines, f"{tmp_path}/g")
    for v in (1, 2):
        mine = sorted((i, r or "") for k, i, r in skips if k == v)
        assert read(f"{tmp_path}/g", f"{v}/gaps.txt") == video_files.GAPS_HEAD.format(len(mine)) + "".join(f"  picture {i + 1:>6}   {r}\n" for i, r in mine)
    empty = spark.createDataFrame([], "video_id long, index long, reason string")
    assert video_files.gap_lines(empty).count() == 0


def test_repairs_and_again(spark):
    frame = lambda *x: spark.createDataFrame(list(x), "id long, status string")
    kinds = {
        "batch": frame((1, "running"), (2, "completed"), (3, None)), "run": frame((1, "running"), (2, "pending")),
        "video": frame((1, "transcribing"), (2, "running"), (3, "completed")), "job": frame((1, "analyzing"), (2, "needs_attention"), (3, "paused"), (4, "preparing")),
    }
    files = spark.createDataFrame([("a",), ("b",), ("b",)], "path string")
    found = {(r.kind, r.id): (r.was, r.now, r.event is not None) for r in state.repairs(*kinds.values(), files, files.where("path = 'a'")).collect()}
    assert found == {
        ("batch", "1"): ("running", "pending", False), ("run", "1"): ("running", "pending", False), ("video", "1"): ("transcribing", "pending", False),
        ("job", "1"): ("analyzing", "ready", True), ("job", "4"): ("preparing", "ready", True), ("file", "b"): ("registered", None, False),
    }
    after = [state.repaired(rows, kind) for kind, rows in kinds.items()]
    assert state.repairs(*after, files, files).count() == 0
    assert [r.status for r in after[0].orderBy("id").collect()] == ["pending", "completed", None]


def test_finished_stages(spark):
    kind = "video_id long, stage string, attempt int, status string, total int, done int, finished_at long, error string"
    runs = spark.createDataFrame([(1, "a", 1, "running", 5, 1, None, None), (1, "a", 2, "running", 5, 2, None, None), (1, "b", 1, "completed", 5, 5, 7, None), (2, "a", 1, "running", None, 0, None, None), (3, "a", 1, "running", 1, 0, None, None)], kind)
    ended = spark.createDataFrame([(1, "a", None, 9, 9, 50, None), (1, "b", "failed", 1, 1, 50, "x"), (2, "a", "failed", None, None, 50, "no room"), (4, "a", None, 1, 1, 50, None)], kind.replace("attempt int, ", ""))
    found = {(r.video_id, r.stage, r.attempt): (r.status, r.total, r.done, r.finished_at, r.error) for r in jobplan.finish_stages(runs, ended).collect()}
    assert found == {
        (1, "a", 1): ("running", 5, 1, None, None), (1, "a", 2): ("completed", 9, 9, 50, None), (1, "b", 1): ("completed", 5, 5, 7, None),
        (2, "a", 1): ("failed", None, 0, 50, "no room"), (3, "a", 1): ("running", 1, 0, None, None),
    }


def test_newest_updated_first(spark):
    rows = [(k % 50, k // 50, ("completed", "running", "completed_with_gaps")[k % 3], None if k % 11 == 0 else k * 7919 % 100) for k in range(500)]
    x = jobplan.available(spark.createDataFrame(rows, "job_id long, sequence int, status string, updated long"))
    kept = sorted((r for r in rows if r[2] != "running"), key=lambda r: (r[3] is None, -(r[3] or 0), r[0], r[1]))
    assert [(r.job_id, r.sequence, r.status, r.updated) for r in x.orderBy("place").collect()] == kept


def test_stage_screen(spark):
    kind = "video_id long, stage string, attempt int, status string, total int, done int, skipped int, age double"
    runs = [
        (1, "frames", 1, "failed", 9, 9, 0, 1.0), (1, "frames", 2, "completed", None, None, None, None), (1, "visual", 1, "running", 1000, 600, 500, 3600.0), (1, "transcribe", 1, "running", None, 3, None, 99.0),
        (2, "frames", 1, "waiting_retry", 0, 0, 0, None), (2, "transcribe", 1, "paused", 7200, 3661, 0, 500.0), (2, "other", 1, "running", 1, 0, 0, 9.0), (9, "frames", 1, "completed", 1, 1, 0, 1.0),
    ]
    videos = spark.createDataFrame([(1, None), (2, False), (3, True)], "video_id long, visual boolean")
    rows = state.stage_screen(spark.createDataFrame(runs, kind), videos).orderBy("video_id", "place").collect()
    assert [tuple(r)[2:] for r in rows if r.video_id == 1] == [
        ("Pictures", 100, "Done", "completed", "", False), ("Transcript", 0, "Working", "running", "", True),
        ("Descriptions", 60, "600 of 1,000", "running", "about 4 hours left", False), ("Put together", 0, "Waiting", "ready", "", False),
    ]
    assert [tuple(r)[2:7] for r in rows if r.video_id == 2] == [("Pictures", 0, "Waiting retry", "waiting_retry", ""), ("Transcript", 50, "1:01:01 of 2:00:00", "paused", ""), ("Descriptions", 0, "Not run", "ready", ""), ("Put together", 0, "Waiting", "ready", "")]
    assert [(r.detail, r.state) for r in rows if r.video_id == 3] == [("Waiting", "ready")] * 4 and len(rows) == 12
