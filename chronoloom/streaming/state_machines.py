"""Progress, leases and refreshes as streams with state and timers.

State lives in Spark's store (RocksDB) under a checkpoint that keeps its name, timers run by event time, and a
row belongs to one batch: a run that was stopped anywhere goes on where its ledger ends."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

# Seconds between writes of progress, between its events, and after which a lease is stale.
WRITE_SECONDS, EVENT_SECONDS, STALE_SECONDS = 2.0, 600.0, 120.0
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NEVER = -1


def _millis(at: pd.Series) -> np.ndarray:
    return at.astype("datetime64[ms]").astype("int64").to_numpy()


def _times(values) -> pd.Series:
    return pd.Series(np.array(values, dtype="int64")).astype("datetime64[ms]")


def published(at: np.ndarray, forced: np.ndarray, last: int, gap: int, pending: bool) -> tuple[list[tuple[int, int]], int, bool]:
    """When something is written and which row's value (-1: the one from before), the last of these times, and whether
    something is held back behind it. The first row and forced ones are written at once, others `gap` after the last
    write at the earliest; what is held back is written then. Places are searched for: rows between are not looked at."""
    out, k, n = [], 0, len(at)
    must, value = np.append(np.flatnonzero(forced), n), -1
    while k < n or pending:
        due = int(at[k]) if last == NEVER else last + gap
        if not pending:
            if last == NEVER or forced[k] or at[k] >= due:
                last = int(at[k])
                out.append((last, k))
            else:
                pending = True
            value, k = k, k + 1
            continue
        f = int(must[np.searchsorted(must, k)])
        if f < n and at[f] <= due:
            last, value, k, pending = int(at[f]), f, f + 1, False
        elif n and at[n - 1] >= due and k < n:
            reached = max(k, int(np.searchsorted(at, due, side="right")))
            last, value, k, pending = due, reached - 1 if reached > k else value, reached, False
        else:
            break
        out.append((last, value))
    return out, last, pending


def announced(at: np.ndarray, done: np.ndarray, total: np.ndarray, last: int, gap: int, before: tuple[int, int]) -> tuple[list[tuple[int, int]], int]:
    """Times of events and the rows whose value they tell (-1: before, its done and total): `gap` after the last one while the run has a total and isn't
    through, else with the next row that has a total."""
    out = []
    while len(at) and last + gap <= at[-1]:
        due = last + gap
        j = int(np.searchsorted(at, due, side="right")) - 1
        d, t = (int(done[j]), int(total[j])) if j >= 0 else before
        if not (t > 0 and d < t):
            later = np.flatnonzero(total[j + 1 :] > 0)
            if not len(later):
                break
            j = j + 1 + int(later[0])
            due = int(at[j])
        out.append((due, j))
        last = due
    return out, last


class Progress(StatefulProcessor):
    """Rows of a run (at, done, total, forced) to what is published: `write` at most every two seconds, at once
    where forced (a total, a flush, the end); what was held back is written when its time has come, also without a new
    row. `event` every ten minutes while the run has a total and isn't through, by a timer."""

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("progress", "last_write long, last_event long, at long, done long, total long, pending boolean")

    def _rows(self, key, rows: list) -> Iterator[pd.DataFrame]:
        if rows:
            what, at, done, total = zip(*rows, strict=True)
            yield pd.DataFrame({"run_id": [key[0]] * len(rows), "what": list(what), "at": _times(at), "done": list(done), "total": pd.Series(list(total), dtype="Int64")})

    def _timers(self, state: tuple) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        last_write, last_event, _, done, total, pending = state
        if pending:
            self.handle.registerTimer(last_write + int(WRITE_SECONDS * 1000))
        if total and done < total:
            self.handle.registerTimer(last_event + int(EVENT_SECONDS * 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(rows)).sort_values(["at", "done"], kind="stable")
        at, forced = _millis(x["at"]), x["forced"].fillna(False).to_numpy(dtype=bool)
        last_write, last_event, _, was, whole, pending = self.state.get() if self.state.exists() else (NEVER, int(at[0]), 0, 0, None, False)
        before = (was, -1 if whole is None else whole)
        total = x["total"].ffill().fillna(before[1]).astype("int64").to_numpy()
        done = np.maximum(x["done"].fillna(0).astype("int64").to_numpy(), 0)
        done = np.where(total >= 0, np.minimum(done, total), done)
        value = lambda k: (int(done[k]), int(total[k]) if total[k] >= 0 else None) if k >= 0 else (was, whole)
        # timers that these rows overtake are made up for in their place
        writes, last_write, pending = published(at, forced, last_write, int(WRITE_SECONDS * 1000), pending)
        events, last_event = announced(at, done, total, last_event, int(EVENT_SECONDS * 1000), before)
        state = (last_write, last_event, int(at[-1]), *value(len(at) - 1), pending)
        self.state.update(state)
        self._timers(state)
        yield from self._rows(key, [("write", t, *value(k)) for t, k in writes] + [("event", t, *value(k)) for t, k in events])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        last_write, last_event, at, done, total, pending = self.state.get()
        out = []
        if pending and now >= last_write + int(WRITE_SECONDS * 1000):
            out.append(("write", now, done, total))
            last_write, pending = now, False
        if total and done < total and now >= last_event + int(EVENT_SECONDS * 1000):
            out.append(("event", now, done, total))
            last_event = now
        state = (last_write, last_event, at, done, total, pending)
        self.state.update(state)
        self._timers(state)
        yield from self._rows(key, out)

    def close(self) -> None:
        pass


class Leases(StatefulProcessor):
    """Rows of a place (at, worker, kind: acquire, beat or release) to what comes of them: acquired, taken over or refused; beat
    or lost; released or ignored. A claim that isn't renewed for two minutes is `stale` by a timer: from then on
    another worker may take it, and until one does a late beat still keeps it."""

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lease", "worker string, beat long, told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(rows)).sort_values(["at", "worker", "kind"], kind="stable")
        holder, beat, told = self.state.get() if self.state.exists() else (None, NEVER, False)
        limit, out = int(STALE_SECONDS * 1000), []
        for at, worker, kind in zip(_millis(x["at"]).tolist(), x["worker"], x["kind"], strict=True):
            stale = holder is None or at - beat > limit
            if holder is not None and stale and not told:  # a timer that this row overtakes
                out.append((beat + limit + 1, holder, "stale"))
                told = True
            if kind == "acquire":
                result = "refused" if not stale and holder != worker else "acquired" if holder in (None, worker) else "taken over"
            elif kind == "beat":
                result = "beat" if holder == worker else "lost"
            else:
                result = "released" if holder == worker else "ignored"
            if result in ("acquired", "taken over", "beat"):
                holder, beat, told = worker, at, False
            elif result == "released":
                holder, beat = None, NEVER
            out.append((at, worker, result))
        self._keep(holder, beat, told)
        at, worker, result = zip(*out, strict=True)
        yield pd.DataFrame({"place": [key[0]] * len(out), "at": _times(at), "worker": list(worker), "result": list(result)})

    def _keep(self, holder, beat: int, told: bool) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if holder is None:
            self.state.clear()
            return
        self.state.update((holder, beat, told))
        if not told:
            self.handle.registerTimer(beat + int(STALE_SECONDS * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            holder, beat, told = self.state.get()
            if not told and expiredTimerInfo.getExpiryTimeInMs() > beat + int(STALE_SECONDS * 1000):
                self.state.update((holder, beat, True))
                yield pd.DataFrame({"place": [key[0]], "at": _times([expiredTimerInfo.getExpiryTimeInMs()]), "worker": [holder], "result": ["stale"]})

    def close(self) -> None:
        pass


class Changes(StatefulProcessor):
    """Rows of a job (at, hash of what its screen shows) to one row when that has changed: how much it adds to the sum of all."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("shown", "hash long, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(rows)).sort_values(["at", "hash"], kind="stable")
        at, now = int(_millis(x["at"])[-1]), int(x["hash"].iloc[-1])
        before, seen = self.state.get() if self.state.exists() else (None, NEVER)
        if at < seen:
            return
        self.state.update((now, at))
        if now != before:
            yield pd.DataFrame({"job_id": [key[0]], "jobs": [int(before is None)], "change": [str(now - (before or 0))]})

    def close(self) -> None:
        pass


def _stateful(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str, late: str | None) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    if late is None:
        return stream.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "None")
    return stream.withWatermark("at", late).groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def progress(stream: DataFrame, late: str = "0 seconds") -> DataFrame:
    """run_id, what, at, done, total. stream: run_id, at, done, total (null: unknown yet), forced."""
    kind = stream.schema["run_id"].dataType.simpleString()
    return _stateful(stream, "run_id", Progress(), f"run_id {kind}, what string, at timestamp, done long, total long", late)


def leases(stream: DataFrame, late: str = "0 seconds") -> DataFrame:
    """place, at, worker, result. stream: place, at, worker, kind."""
    kind = stream.schema["place"].dataType.simpleString()
    return _stateful(stream, "place", Leases(), f"place {kind}, at timestamp, worker string, result string", late)


# ------------------------------------------------------------------ batches that are written once


def run_batches(stream: DataFrame, name: str, folder: str, write: Callable[[DataFrame, int], DataFrame | None] | None = None, most_files: int | None = None) -> None:
    """Everything that is there now, batch by batch, under a checkpoint that keeps its name (folder/name). A batch is
    written to a folder of its own, which a second attempt replaces, and counts when its ledger entry stands behind
    it: stopped in between, the next run writes the same batch again. write may replace a batch's rows (it must not depend on how often it runs)."""
    spark = stream.sparkSession
    base = f"{folder.rstrip('/')}/{name}"

    def step(rows: DataFrame, batch: int) -> None:
        rows = (write(rows, batch) if write else None) or rows
        rows.write.mode("overwrite").parquet(f"{base}/rows/batch={batch}")
        spark.createDataFrame([(name, batch)], "query string, batch long").coalesce(1).write.mode("overwrite").parquet(f"{base}/ledger/entry={batch}")

    q = stream.writeStream.queryName(name).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(step).start()
    q.awaitTermination()


def batches(spark: SparkSession, name: str, folder: str, schema: str) -> DataFrame:
    """The rows of all batches that the ledger has, with their batch."""
    base = f"{folder.rstrip('/')}/{name}"
    rows = spark.read.schema(f"{schema}, batch long").option("basePath", f"{base}/rows").parquet(f"{base}/rows")
    ledger = spark.read.schema("query string, batch long").option("recursiveFileLookup", "true").parquet(f"{base}/ledger")
    return rows.join(ledger.select("batch").distinct(), "batch", "left_semi")


def refreshes(stream: DataFrame, name: str, folder: str) -> DataFrame:
    """One row for each batch after which a screen of all jobs would differ: batch, jobs, fingerprint. stream: job_id, at and the
    columns that the screen shows. A job's last hash is state; its changes add up to one sum a batch,
    kept beside the batch, so that no batch reads the jobs that didn't change."""
    shown = [c for c in stream.columns if c not in ("job_id", "at")]
    hashed = stream.select("job_id", "at", F.xxhash64("job_id", *shown).alias("hash"))
    spark, base = stream.sparkSession, f"{folder.rstrip('/')}/{name}"
    kind = "jobs long, sum string, fingerprint string, changed boolean"

    def totals(rows: DataFrame, batch: int) -> DataFrame:
        added = rows.agg(F.coalesce(F.sum("jobs"), F.lit(0)).alias("jobs"), F.coalesce(F.sum(F.col("change").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("change")).first()
        before = None if not batch else batches(spark, name, folder, kind).where(F.col("batch") < batch).orderBy(F.desc("batch")).first()
        jobs, total = (before.jobs if before else 0) + added.jobs, int(before.sum if before else 0) + int(added.change)
        mark = spark.range(1).select(F.substring(F.sha2(F.lit(f"{jobs}|{total}"), 256), 1, 16)).first()[0]
        return spark.createDataFrame([(jobs, str(total), mark, before is None or before.fingerprint != mark)], kind)

    key = stream.schema["job_id"].dataType.simpleString()
    run_batches(_stateful(hashed, "job_id", Changes(), f"job_id {key}, jobs long, change string", None), name, folder, totals)
    return batches(spark, name, folder, kind).where("changed").select("batch", "jobs", "fingerprint")
