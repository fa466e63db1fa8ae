"""Global and per-key places against plain sorting."""

import hashlib
import random

from pyspark.sql import functions as F

from chronoloom.operators import jobplan, ranks, state

KIND = "id long, key string, value double"


def rows_of(n=3000):
    rng = random.Random(5)
    return [(k, rng.choice(["a", "a", "a", "b", None, "c"]), None if k % 97 == 0 else float(rng.randrange(40))) for k in range(n)]


def test_places_of_all_rows(spark):
    rows = rows_of()
    got = {r.id: r.rank for r in ranks.ranked(spark.createDataFrame(rows, KIND).repartition(5), F.desc("value"), "id").collect()}
    want = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
    assert got == {r[0]: k for k, r in enumerate(want, 1)}


def test_places_within_hot_keys(spark):
    """One key holds half of all rows and lies in several ranges; null is a key."""
    rows = rows_of()
    got = {r.id: r.place for r in ranks.ranked(spark.createDataFrame(rows, KIND).repartition(5), "value", "id", by=("key",), name="place").collect()}
    want = {}
    for key in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        want |= {r[0]: k for k, r in enumerate(mine, 1)}
    assert got == want


def test_order_statistics_and_pages(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, KIND)
    got = {r.key: r.value for r in ranks.at_rank(df, "value", F.floor(F.col("_count") / 2) + 1, "key").collect()}
    for key in {r[1] for r in rows}:
        v = sorted(r[2] for r in rows if r[1] == key and r[2] is not None)
        assert got[key] == v[len(v) // 2]
    for number, first in ((1, 0), (3, 400), (99, 2800), (-4, 0)):
        page = ranks.page(df, number, 200, "id").collect()
        assert sorted(r.id for r in page) == list(range(first, min(first + 200, 3000))) and {r.pages for r in page} == {15}
    none = spark.createDataFrame([], KIND)
    assert ranks.page(none, 2, 20, "id").count() == 0 and ranks.ranked(none, "id").count() == 0 and ranks.at_rank(none, "value", F.lit(1), "key").count() == 0


def test_no_task_holds_a_whole_key(spark):
    """100,000 rows of one key are dealt over all ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    one = spark.range(100_000).select(F.lit("k").alias("key"), F.hash("id").alias("value"), "id")
    out = ranks.ranked(one, "value", "id", by=("key",))
    held = out.groupBy(F.spark_partition_id().alias("p")).count()
    assert out.agg(F.max("rank"), F.count_distinct("rank")).first()[:] == (100_000, 100_000)
    most = held.agg(F.max("count")).first()[0]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert most < 40_000


def test_upper_median(spark):
    rows = rows_of()
    got = {r.key: r[1:] for r in jobplan.upper_median(spark.createDataFrame(rows, KIND), "key", "value").collect()}
    for key in {r[1] for r in rows}:
        v = sorted(r[2] for r in rows if r[1] == key and r[2] is not None)
        assert got[key] == (v[len(v) // 2], v[0], v[-1], len(v))


def test_digest_in_order_does_not_depend_on_partitions(spark):
    rows = [(k, "done" if k % 3 else "new") for k in range(5000)]
    level = [f"{k}:{s}" for k, s in rows]
    while True:
        level = [hashlib.sha256("\n".join(level[k : k + state.FAN]).encode()).hexdigest() for k in range(0, len(level), state.FAN)]
        if len(level) == 1:
            break
    df = spark.createDataFrame(rows, "id long, status string")
    line = F.concat_ws(":", "id", "status")
    assert {state.ordered_digest(df.repartition(n), line, "id") for n in (1, 64)} == {level[0]}
    assert state.ordered_digest(df.where("id = 7"), line, "id") == hashlib.sha256(b"7:done").hexdigest()
    assert state.ordered_digest(df.where("false"), line, "id") == hashlib.sha256(b"").hexdigest()


def test_requests_over_the_same_sources(spark):
    jobs = spark.createDataFrame([(j, t, s) for j, t, ss in [(1, 10, "ab"), (2, 20, "ba"), (3, 20, "ab"), (4, 30, "abb"), (5, 5, "c"), (6, 6, "cd")] for s in ss], "job_id int, created_at int, source string")
    asked = spark.createDataFrame([(r, s) for r, ss in [(1, "ab"), (2, "bab"), (3, "c"), (4, "d"), (5, "dc"), (6, "abc")] for s in ss], "request int, source string")
    assert {r.request: r.job_id for r in state.same_sources_of(asked, jobs).collect()} == {1: 3, 2: 4, 3: 5, 4: None, 5: 6, 6: None}
