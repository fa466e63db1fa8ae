"""Streams with state, timers and a ledger: late timers, takeovers, restarts."""

import datetime as dt

import numpy as np
import pytest

from chronoloom.streaming import state_machines as M

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
RUNS = "run_id string, at timestamp, done long, total long, forced boolean"
CLAIMS = "place string, at timestamp, worker string, kind string"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def seconds(t):
    return (t.replace(tzinfo=dt.UTC) - START).total_seconds()


def put(spark, path, name, rows, schema):
    """One more file for a stream to read: a batch of its own."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}")


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


@pytest.fixture(autouse=True)
def two_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_publishing_does_not_depend_on_batches():
    """Against one walk over all rows, cut into batches anywhere."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        times, forced = np.sort(rng.choice(200, n, replace=False)), rng.random(n) < 0.1
        last, held, want = M.NEVER, None, []
        for k, t in enumerate(times.tolist()):
            while held is not None and last + 9 < t:
                last = last + 9
                want.append((last, held))
                held = None
            if forced[k] or last == M.NEVER or t - last >= 9:
                last, held = t, None
                want.append((t, k))
            else:
                held = k
        got, now, pending, base, at = [], M.NEVER, False, -1, 0
        for edge in [*sorted(rng.choice(n + 1, 3).tolist()), n]:
            if edge > at:
                out, now, pending = M.published(times[at:edge], forced[at:edge], now, 9, pending)
                got += [(t, at + k if k >= 0 else base) for t, k in out]
                base, at = edge - 1, edge
        assert got == want


def test_progress_with_late_timers(spark, tmp_path):
    """What was held back comes at two seconds, an event at ten minutes, both without a new row of the run."""
    rows = [("a", at(0), 0, 100, True), ("a", at(0.5), 5, None, False), ("a", at(1), 9, None, False), ("b", at(0), 1, None, False)]
    put(spark, tmp_path / "in", "1", rows, RUNS)
    put(spark, tmp_path / "in", "2", [("b", at(700), 2, None, False)], RUNS)
    put(spark, tmp_path / "in", "3", [("a", at(701), 150, None, False), ("b", at(701), 3, None, True)], RUNS)
    M.run_batches(M.progress(stream(spark, tmp_path / "in", RUNS)), "progress", f"file://{tmp_path}/out")
    got = M.batches(spark, "progress", f"file://{tmp_path}/out", "run_id string, what string, at timestamp, done long, total long").collect()
    mine = sorted((r.run_id, r.what, seconds(r.at), r.done, r.total) for r in got)
    assert mine == [
        ("a", "event", 600.0, 9, 100), ("a", "write", 0.0, 0, 100), ("a", "write", 2.0, 9, 100), ("a", "write", 701.0, 100, 100),
        ("b", "write", 0.0, 1, None), ("b", "write", 700.0, 2, None), ("b", "write", 701.0, 3, None),
    ]


def test_leases(spark, tmp_path):
    """Refused while alive, stale after 120 seconds and not before, taken over, lost, released."""
    steps = [
        ("x", 0, "w1", "acquire"), ("x", 15, "w1", "beat"), ("x", 16, "w2", "acquire"), ("x", 135, "w2", "acquire"), ("x", 135.001, "w2", "acquire"), ("x", 140, "w1", "beat"), ("x", 141, "w1", "release"),
        ("x", 150, "w2", "release"), ("x", 151, "w1", "acquire"), ("x", 152, "w1", "acquire"), ("y", 160, "w3", "beat"), ("y", 161, "w3", "acquire"), ("z", 400, "w9", "acquire"), ("y", 401, "w3", "beat"),
    ]
    for k, part in enumerate((steps[:3], steps[3:8], steps[8:12], steps[12:13], steps[13:])):
        put(spark, tmp_path / "in", str(k), [(p, at(t), w, kind) for p, t, w, kind in part], CLAIMS)
    M.run_batches(M.leases(stream(spark, tmp_path / "in", CLAIMS)), "leases", f"file://{tmp_path}/out")
    got = M.batches(spark, "leases", f"file://{tmp_path}/out", "place string, at timestamp, worker string, result string").collect()
    told = sorted((r.place, seconds(r.at), r.worker, r.result) for r in got)
    assert [t for t in told if t[3] != "stale"] == sorted([
        ("x", 0.0, "w1", "acquired"), ("x", 15.0, "w1", "beat"), ("x", 16.0, "w2", "refused"), ("x", 135.0, "w2", "refused"), ("x", 135.001, "w2", "taken over"), ("x", 140.0, "w1", "lost"), ("x", 141.0, "w1", "ignored"),
        ("x", 150.0, "w2", "released"), ("x", 151.0, "w1", "acquired"), ("x", 152.0, "w1", "acquired"), ("y", 160.0, "w3", "lost"), ("y", 161.0, "w3", "acquired"), ("z", 400.0, "w9", "acquired"), ("y", 401.0, "w3", "beat"),
    ])
    assert [t for t in told if t[3] == "stale"] == [("x", 135.001, "w1", "stale"), ("x", 272.001, "w1", "stale"), ("y", 281.001, "w3", "stale")]


def test_stopped_between_write_and_commit(spark, tmp_path):
    """Killed after a batch's rows and before its ledger entry: the next run writes it again, no row twice, none lost."""
    kind = "n long"
    for k in range(3):
        put(spark, tmp_path / "in", str(k), [(10 * k + j,) for j in range(5)], kind)
    out, calls = f"file://{tmp_path}/out", []

    def killed(rows, batch):
        calls.append(batch)
        if batch == 1 and calls.count(1) == 1:
            rows.write.mode("overwrite").parquet(f"{out}/numbers/rows/batch=1")
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        M.run_batches(stream(spark, tmp_path / "in", kind), "numbers", out, killed)
    first = sorted(r.n for r in M.batches(spark, "numbers", out, kind).collect())
    assert first == sorted(10 * k + j for k in sorted({r.n // 10 for r in M.batches(spark, "numbers", out, kind).collect()}) for j in range(5)) and len(first) == 5
    put(spark, tmp_path / "in", "9", [(90 + j,) for j in range(5)], kind)
    M.run_batches(stream(spark, tmp_path / "in", kind), "numbers", out, killed)
    M.run_batches(stream(spark, tmp_path / "in", kind), "numbers", out, killed)
    assert sorted(r.n for r in M.batches(spark, "numbers", out, kind).collect()) == sorted(10 * k + j for k in (0, 1, 2, 9) for j in range(5))
    assert calls == [0, 1, 1, 2, 3]


def test_refresh_only_on_change(spark, tmp_path):
    kind = "job_id long, at timestamp, status string"
    files = [[(1, 0, "ready"), (2, 0, "ready")], [(1, 1, "ready")], [(1, 2, "running"), (1, 3, "done")], [(2, 4, "ready"), (1, 1, "old")], [(3, 5, "new")]]
    for k, rows in enumerate(files):
        put(spark, tmp_path / "in", str(k), [(j, at(t), s) for j, t, s in rows], kind)
    got = M.refreshes(stream(spark, tmp_path / "in", kind), "screen", f"file://{tmp_path}/out").orderBy("batch").collect()
    assert len(got) == 3 and [r.jobs for r in got] == [2, 2, 3] and len({r.fingerprint for r in got}) == 3
    again = M.refreshes(stream(spark, tmp_path / "in", kind), "screen", f"file://{tmp_path}/out")
    assert again.count() == 3
