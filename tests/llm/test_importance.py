"""Importance resampling against a plain version."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from chronoloom.llm import common, importance

UPPER = {k: k + 32 for k in range(65, 91)}
TARGET = ["the capital of france is paris", "One two THREE four five six seven", None, "", "É è ç 日本 ß"]


def runs(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(rows, target, percent=5, least=20, seed=42, buckets=10_000):
    own = [(d, *runs(t)) for d, t in rows]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = collections.Counter(bucket(f) for _, _, fs in own for f in fs)
    t = collections.Counter(bucket(f) for x in target for f in runs(x)[1])
    S, T = sum(s.values()), sum(t.values())
    out = []
    for d, n, fs in own:
        w = sum(math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_crcs_of_runs():
    rng = np.random.default_rng(3)
    texts = ["", "a", "Ab cd  e\tf9 " + "x" * 31 + " " + "y" * 32 + " " + "z" * 33 + " q " + "w" * 5000 + " end", "日本 é-ü one", " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(1, 70)))) for _ in range(500))]
    doc, crc = importance.features(common.Words(pa.array(texts), "alnum", lower=True))
    for k, t in enumerate(texts):
        assert sorted(crc[doc == k].tolist()) == sorted(zlib.crc32(f.encode()) for f in runs(t)[1])


@pytest.mark.parametrize("percent,least,entries", [(5, 20, 1 << 20), (50, 3, 1 << 20), (100, 0, 1 << 20)])
def test_against_brute_force(spark, docs, texts, percent, least, entries):
    rows = [*enumerate(texts), (None, " ".join(f"w{k}" for k in range(60))), (7, texts[7]), (7, None)]
    df = docs.select("doc_id", "text", "score", "bucket").unionByName(spark.createDataFrame([(d, t, "s", 1.0) for d, t in rows[len(texts) :]], "doc_id long, text string, score string, bucket double"))
    target = spark.createDataFrame(list(enumerate(TARGET)), "item_id long, text string")
    got = importance.draw(df, target, percent=percent, least=least).collect()
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got), key=str) == brute(rows, TARGET, percent, least)


def test_empty_tables_and_other_seeds(spark, docs, none, texts):
    target = spark.createDataFrame([], "item_id long, text string")
    assert importance.draw(none, target).count() == 0
    got = importance.draw(docs, target, seed=7, percent=30).collect()
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got), key=str) == brute(list(enumerate(texts)), [], percent=30, seed=7)


def test_drawn_documents_keep_columns(spark, docs, texts):
    target = spark.createDataFrame(list(enumerate(TARGET)), "item_id long, text string")
    out = importance.resample(docs, target, percent=30)
    want = {r[0] for r in brute(list(enumerate(texts)), TARGET, 30) if r[4] is not None}
    assert out.columns == docs.columns and {r.doc_id: r.text for r in out.collect()} == {k: texts[k] for k in want}
