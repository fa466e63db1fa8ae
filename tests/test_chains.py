"""Greedy chains against the plain walk, whatever the ranges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import chains, packing, state


def fit(values, limit, alone):
    out, number, held, closed = [], 0, 0, True
    for v, own in zip(values, alone, strict=True):
        if own or closed or held + v > limit:
            number, held = number + 1, 0
        held, closed = held + v, own
        out.append(number)
    return out


def gap(values, limit):
    out, last = [], None
    for v in values:
        out.append(last is None or v - last >= limit)
        last = v if out[-1] else last
    return out


@pytest.mark.parametrize("seed", range(6))
def test_blocks_of_every_size(seed):
    """A key cut anywhere: maps of states lead to the same starts as one walk."""
    rng = np.random.default_rng(seed)
    n = 300
    values, alone = rng.integers(0 if seed % 2 else 1, 60, n).astype(float), rng.random(n) < [0, 0.05, 0.5][seed % 3]
    times = np.sort(rng.integers(0, 800, n)).astype(float)
    for strict, limit in ((True, 100.0), (True, 5000.0), (False, 7.0), (False, 0.0), (False, 400.0)):
        v, own = (values, alone | (values > limit)) if strict else (times, np.zeros(n, dtype=bool))
        want = np.diff(np.array([0, *fit(v, limit, own)])) > 0 if strict else np.array(gap(v, limit))
        for pieces in (1, 2, 7, 60):
            edge = np.sort(rng.choice(np.arange(1, n), pieces - 1, replace=False)).tolist()
            now, got = -np.inf, []
            for a, b in zip([0, *edge], [*edge, n], strict=True):
                total = np.cumsum(v[a:b])
                links = chains.Links(total, total - v[a:b], own[a:b], limit, True) if strict else chains.Links(v[a:b], v[a:b], own[a:b], limit, False)
                got += links.marks(now).tolist()
                shift = float(total[-1]) if strict else 0.0
                limits, states, counts = links.steps(0.0 if strict else v[a], shift)
                k = int(np.searchsorted(limits, now + limit, side="right" if strict else "left"))
                assert sum(got[a:b]) == (counts[k] if k < len(limits) else 0)
                now = states[k] if k < len(limits) else now - shift
            assert got == want.tolist(), (strict, limit, pieces)


def test_one_key_over_many_ranges(spark):
    """200,000 rows of one key, some of others and of none: as the walk, and no range holds the key."""
    rng = random.Random(3)
    rows = [("hot", k, rng.randrange(200, 900)) for k in range(60_000)] + [(key, k, rng.randrange(1, 6000)) for key in ("a", "z", None) for k in range(300)]
    df = spark.createDataFrame(rows, "collection string, sequence int, tokens int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.collection, r.sequence): (r.part, r.oversized) for r in packing.next_fit(df, 4000).collect()}
        late = [(key, float(t)) for key in ("hot", "b") for t in (rng.randrange(100_000) for _ in range(30_000 if key == "hot" else 50))]
        kept = sorted((r.key, r.at) for r in state.throttle(spark.createDataFrame(late, "key string, at double").repartition(5), 7.0).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for key in ("hot", "a", "z", None):
        mine = [r for r in rows if r[0] == key]
        numbers = fit([r[2] for r in mine], 4000, [r[2] > 4000 for r in mine])
        assert [got[key, r[1]] for r in mine] == [(n, r[2] > 4000) for n, r in zip(numbers, mine, strict=True)]
    want = []
    for key in ("hot", "b"):
        times = sorted(t for k, t in late if k == key)
        want += [(key, t) for t, keep in zip(times, gap(times, 7.0), strict=True) if keep]
    assert kept == sorted(want)


def test_budgets_of_their_own_and_no_room(spark):
    rows = spark.createDataFrame([("a", k, 5, 10) for k in range(5)] + [("b", k, 5, 5) for k in range(3)], "collection string, sequence int, tokens int, room int")
    assert sorted((r.collection, r.sequence, r.part) for r in packing.next_fit(rows, F.col("room")).collect()) == [("a", k, k // 2 + 1) for k in range(5)] + [("b", k, k + 1) for k in range(3)]
    for budget, split in ((0, False), (1000, True)):
        with pytest.raises(ValueError):
            packing.units(rows, budget, split)
