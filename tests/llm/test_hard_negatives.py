"""Hard negatives against all pairs."""

import math
import random

import numpy as np

from chronoloom.llm import hard_negatives

KIND = "vec_id long, embedding array<double>, label int"


def brute(rows, positives=5, negatives=5, every=10):
    """rows: (vec_id, vector, label); anchors: vec_id divisible by `every`."""
    good = []
    for v, x, label in rows:
        if v is None or x is None or label is None or any(y is None or not math.isfinite(y) for y in x):
            continue
        good.append((v, [math.floor(256 * y) for y in x], label))
    anchors = {}
    for v, x, label in good:
        if v % every == 0:
            anchors[v] = min(anchors.get(v, (label, x)), (label, x))
    out = []
    for a, (label, x) in anchors.items():
        near = [(sum(p * q for p, q in zip(x, y, strict=True)), v, other) for v, y, other in good if len(y) == len(x)]
        near.sort(key=lambda r: (-r[0], r[1]))
        for ps, p, _ in [r for r in near if r[2] == label and r[1] != a][:positives]:
            fit = [(ns, n) for ns, n, other in near if other != label and 80 * ps <= 100 * ns <= 100 * ps][:negatives]
            out += [(a, p, k, n, ps, ns) for k, (ns, n) in enumerate(fit, 1)]
    return sorted(out)


def found(df, *args, every=10, **more):
    got = hard_negatives.mine(df, df.where(f"vec_id % {every} = 0"), *args, **more).collect()
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got)


def vectors(n=400, d=8, labels=4, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        scale = rng.choice([0.01, 0.3, 1.0, 4.0])
        rows.append((k, [scale * rng.choice([-1, -0.5, 0.25, 0.5, 1]) for _ in range(d)], rng.randrange(labels)))
    return rows


def odd_rows():
    return [
        (1000, None, 1), (1001, [0.5] * 8, None), (1002, [None] * 8, 1), (1003, [float("nan")] * 8, 1), (1004, [float("inf")] * 8, 2), (None, [1.0] * 8, 1),
        (1010, [], 1), (1011, [], 1), (1012, [], 2), (1020, [0.0] * 8, 1), (1030, [1.0, 2.0], 1), (1031, [1.0, 2.0], 1), (1032, [1.0, 1.9], 2), (1033, [1.0, 2.0], 2),
    ]


def test_against_all_pairs(spark):
    rows = [*vectors(), *odd_rows()]
    rows += [(k, [1.0] * 8, k % 2) for k in range(2000, 2060)]  # one vector many times
    rows += [(50, [0.75] * 8, 3), (51, [0.75] * 8, 3), (51, [0.75] * 8, 3), (53, [0.75] * 8, 2), (53, [0.75] * 8, 2)]
    df = spark.createDataFrame(rows, KIND).repartition(4)
    want = brute(rows)
    assert found(df) == want and len(want) > 300
    assert found(df, 2, 9) == brute(rows, 2, 9)


def test_scores_beyond_doubles(spark):
    rows = [(k, [3e5 + k / 256, 3.0, 5e5], k % 3) for k in range(40)]
    assert found(spark.createDataFrame(rows, KIND)) == brute(rows)
    rows = [(k, [1e13, 1e306 if k == 1 else 3.0], k % 3) for k in range(40)]
    got = found(spark.createDataFrame(rows, KIND))
    assert len(got) == 4 * 5 * 5 and {r[4] for r in got} == {r[5] for r in got} == {2**63 - 1}


def test_small_buckets_and_pruning():
    """Every size of bucket finds the same; large norms first, most buckets are left out."""
    rng = np.random.default_rng(4)
    v = np.floor(rng.normal(size=(2000, 16)) * rng.lognormal(sigma=1.5, size=(2000, 1)) * 256)
    labels, ids = rng.integers(0, 5, 2000), np.arange(2000)
    norms = np.linalg.norm(v, axis=1)
    order = np.argsort(-norms)
    a = order[:40]
    results, work = [], []
    for size in (1, 7, 64, 2000):
        windows = hard_negatives.Running(40, 5)
        parts = [order[k : k + size] for k in range(0, 2000, size)]
        work.append(hard_negatives.search(norms[a], v[a], labels[a], ids[a], windows, np.arange(40), [(norms[p[0]], ids[p], labels[p], v[p]) for p in parts], True))
        results.append((windows.window.tolist(), windows.ids.tolist(), windows.score.tolist()))
    assert all(r == results[0] for r in results)
    assert work[2] < 0.5 * work[3]


def test_empty_table_and_other_columns(spark):
    assert found(spark.createDataFrame([], KIND)) == []
    rows = vectors(60)
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, KIND).withColumns({"d": F.lit("x"), "norm": F.lit(None).cast("int"), "rank": F.lit(1), "need": F.lit(True), "block": F.lit("b")})
    assert found(df) == brute(rows)
