import collections
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from chronoloom.llm import context_tree as ct


def brute(rows):
    """Scores by a dictionary of nodes and a recursion over depths."""
    train = [t for k, t in rows if k is None or zlib.crc32(str(k).encode()) % 10]
    n = collections.Counter()
    grams = lambda t: [(bytes([ct.END] * ct.DEPTH) + (t or "").encode() + bytes([ct.END]))[i : i + ct.DEPTH + 1] for i in range(len((t or "").encode()) + 1)]
    bits = lambda b: [(b >> (7 - p)) & 1 for p in range(8)]
    for t in train:
        for g in grams(t):
            for d in range(ct.DEPTH + 1):
                for p in range(8):
                    n[g[ct.DEPTH - d : ct.DEPTH], p, g[-1] >> (8 - p), bits(g[-1])[p]] += 1
    every = {k[:3] for k in n}
    below = collections.defaultdict(list)
    for c, p, q in every:
        if c:
            below[c[1:], p, q].append((c, p, q))
    memo = {}

    def kt(node):
        a, b = n[*node, 0], n[*node, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(node):
        if node not in memo:
            memo[node] = kt(node) if len(node[0]) == ct.DEPTH else np.logaddexp(kt(node), sum(weighted(x) for x in below[node])) - math.log(2)
        return memo[node]

    def score(t):
        out = 0.0
        for g in grams(t):
            for p in range(8):
                value = None
                for d in range(ct.DEPTH, -1, -1):
                    node = (g[ct.DEPTH - d : ct.DEPTH], p, g[-1] >> (8 - p))
                    own = (n[*node, bits(g[-1])[p]] + 0.5) / (n[*node, 0] + n[*node, 1] + 1)
                    if d == ct.DEPTH:
                        value = own
                    else:
                        odds = kt(node) - sum(weighted(x) for x in below[node])
                        stop = 1 / (1 + math.exp(-odds))
                        value = stop * own + (1 - stop) * value
                out += math.log10(value)
        return out

    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    c = collections.Counter(w for t in train for w in words(t))
    total, kinds = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in words(t))
    return [(k is not None and zlib.crc32(str(k).encode()) % 10 == 0, len(words(t)), sum(c[w] > 0 for w in words(t)), total, base(t), score(t)) for k, t in rows]


def test_against_brute_force(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate(["the cat sat", "The cat sat on the mat", None, "", "ab" * 40, "émile 日本", "  x ", *["the mat and the cat"] * 3, *[f"doc {k} the cat" for k in range(12)]])] + [(None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    from pyspark.sql import functions as F

    df = df.withColumns({"score": F.lit(1), "held_out": F.lit("x"), "bucket": F.lit(0), "_block": F.lit(9)})
    want = {k: v for (k, _), v in zip(rows, brute(rows), strict=True)}
    for size in (ct.BLOCK_BYTES, 60):  # one block, and several
        monkeypatch.setattr(ct, "BLOCK_BYTES", size)
        got = {r.doc_id: r for r in ct.score(df).collect()}
        assert len(got) == len(rows)
        for k, w in want.items():
            r = got[k]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
            assert r.base_score == pytest.approx(w[4]) and r.score == pytest.approx(w[5])
            assert r.bits_per_byte == pytest.approx(-w[5] / math.log10(2) / (1 + len((dict(rows)[k] or "").encode())))


def test_probabilities_sum_to_one():
    """All bytes after one context: their probabilities by the tree sum to 1."""
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 48, 300).astype(np.uint64))
    counts = rng.integers(0, 5, len(keys))
    context = keys[0] >> np.uint64(8)
    more = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
    all_keys, n = ct._unique(np.concatenate([keys, more]), np.concatenate([counts, np.zeros(256, dtype=np.int64)]))
    top = ct.Tree(all_keys, n, top=0)
    p = np.prod([top.mixed(place) for place in range(8)], axis=0)
    own = np.isin(all_keys, more)
    assert p[own].sum() == pytest.approx(1.0)


def test_log_kt():
    for a, b in itertools.product((0, 1, 5, 255, 256, 1000, 10**7), repeat=2):
        want = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        assert ct.log_kt(np.array([a]), np.array([b]))[0] == pytest.approx(want, rel=1e-9, abs=1e-6)


def test_empty_and_untrained(spark, none):
    assert ct.score(none).count() == 0
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0)
    r = ct.score(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).first()
    assert r.held_out and r.train_tokens == 0 and r.n_known == 0
    assert r.score == pytest.approx(3 * 8 * math.log10(0.5)) and r.base_score == pytest.approx(0.0)


def test_hot_contexts_are_split_at_the_third_byte():
    """Values by subtrees of two and of three bytes are those of one tree over all."""
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 3, (4000, 6)).astype(np.uint64) @ (np.uint64(256) ** np.arange(6, dtype=np.uint64)))
    counts = rng.integers(0, 4, len(keys))
    one = ct.Tree(keys, counts, top=0)
    want = sum(np.log10(one.mixed(place)) for place in range(8))
    batch = pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "n"])
    two = np.unique(keys >> np.uint64(32))
    for hot in (two[:0], two[::2], two):
        rows = [r for b in ct._roots(hot)([batch]) for r in b.to_pylist()]
        crown = ct.Crown(rows, hot)
        got = {}
        for k, n, top in ct._contexts([batch], hot):
            tree = ct.Tree(k, n, top)
            got |= zip(k.tolist(), sum(np.log10(crown.finish(k, place, tree.mixed(place), top)) for place in range(8)).tolist(), strict=True)
        assert np.allclose([got[k] for k in keys.tolist()], want)


def test_packed_keys():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 999, dtype=np.int64).astype(np.uint64) * np.uint64(2))
    assert np.array_equal(ct.unpack_sorted(ct.pack_sorted(keys)), keys) and len(ct.unpack_sorted(ct.pack_sorted(keys[:0]))) == 0
