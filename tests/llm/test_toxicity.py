import random
import tracemalloc
import zlib

import numpy as np
import pytest
from itertools import combinations

from chronoloom.llm import toxicity


def direct(a, b):
    """The normalised kernel by listing all subsequences."""
    def sub(w):
        out = {}
        for t in combinations(range(len(w)), toxicity.LENGTH):
            u = tuple(w[k] for k in t)
            out[u] = out.get(u, 0) + toxicity.DECAY ** (t[-1] - t[0] + 1)
        return out

    x, y = sub(a), sub(b)
    dot = lambda p, q: sum(v * q.get(u, 0) for u, v in p.items())
    return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5


def test_kernel_equals_its_definition():
    words = [toxicity.letters(w) for w in (b"idiot", b"id-iot", b"idxiot", b"banana", b"toxic")]
    k = toxicity.kernel(toxicity.features(words), toxicity.features(words))
    want = np.array([[direct(a, b) for b in words] for a in words])
    assert np.allclose(k, want)
    assert k[0, 1] == pytest.approx(1.0) and k[0, 2] > k[0, 3]


def test_table_values_equal_kernel_sums():
    pos, neg = [b"grumbol", b"snarfik"], [b"window", b"table", b"garden"]
    weights, bias = toxicity.fit_words(pos, neg)
    model = toxicity.Model(weights, bias, np.zeros(toxicity.TOP + 1))
    for w in (b"grumbol", b"garden", b"grum-bol", b"q", b"aaaaaaaaaaaaaaaaaaaaaaaaaaaa"):
        f = toxicity.features([p for p in toxicity.pieces(toxicity.letters(w))])
        want = max([bias, *(bias + sum(weights[c] * x for c, x in row.items()) for row in f if row)])
        got = model.words(np.frombuffer(w, dtype=np.uint8), np.array([0]), np.array([len(w)]))[0]
        assert got == pytest.approx(want)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    plain = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 5))) for _ in range(300)]
    rows, marks = [], []
    for k in range(500):
        w = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        bad = k % 5 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["grumbol", "snarfik", "Zwackel!", "GRUM-BOL"])
        rows.append((k, " ".join(w)))
        marks.append((k, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (9999, 0, 1), (1, 0, None)], "doc_id long, quality int, toxic int")
    return docs, labels, {k: t for k, _, t in marks}


def test_held_out_rows(labelled):
    docs, labels, truth = labelled
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == 500 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_odd_rows(spark, docs, none, texts, labelled):
    _, labels, _ = labelled
    assert toxicity.score(none, labels).count() == 0
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == len(texts) and all(r.score is not None for r in rows)
    assert {r.score for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.clean(docs, labels.limit(0)).columns == docs.columns


def test_inserted_digits_and_signs_leave_a_word_its_value():
    words = [b"idiot", b"id1iot", b"1d2i3o4t", b"id-iot", b"i9", b"2024", b"mp3"]
    rng = np.random.default_rng(5)
    model = toxicity.Model(rng.normal(size=toxicity._ALPHABET**toxicity.LENGTH), 0.1, np.zeros(toxicity.TOP + 1))
    ends = np.cumsum([len(w) for w in words])
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    starts = np.concatenate([[0], ends[:-1]])
    got, plain = model.words(data, starts, ends), model._read(toxicity._CLASS[data], starts, ends)
    alone = lambda w: model._read(toxicity._CLASS[np.frombuffer(w, dtype=np.uint8)], np.array([0]), np.array([len(w)]))[0]
    assert got[1] == max(plain[1], alone(b"idiot")) >= got[0] and got[2] == max(plain[2], alone(b"diot")) and got[3] == got[0] == plain[0]
    assert list(got[4:6]) == list(plain[4:6]) and got[6] == max(plain[6], alone(b"mp"))


def test_only_equal_sets_of_words_are_copies():
    """Two texts with equal smallest hashes, a copy in another order, and long words with equal beginnings."""
    import pyarrow as pa

    base = [f"w{k}" for k in range(40)]
    texts = [" ".join(base), " ".join([*reversed(base), "W1"]), *(" ".join([*base, f"x{k}"]) for k in range(20)), ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array(texts)], names=["doc_id", "toxic", "text"])
    found = [(r["low"], r["high"]) for b in toxicity._sketches([batch]) for r in b.to_pylist()]
    assert found[0] == found[1] and len(set(found)) == len(texts) - 1
    long = pa.RecordBatch.from_arrays([pa.array(["a" * 300 + "b " + "a" * 300 + "c"]), pa.array([1])], names=["text", "toxic"])
    assert sorted(len(r["word"]) for b in toxicity._word_rows([long]) for r in b.to_pylist()) == [301, 301]


def plain_score(model, text):
    """A document's score by the definition: every distinct word's kernel sums, the three highest, the curve."""
    import re

    raw = (text or "").translate({k: k + 32 for k in range(65, 91)})
    found = {w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", raw)}
    runs = toxicity._spelled(raw.encode())

    def value(word):
        best = model.bias
        read = [word]
        bare = bytes(b for b in word if not 48 <= b <= 57)
        if bare != word and sum(1 for b in bare if toxicity._CLASS[b]) >= toxicity.LENGTH - 1:
            read.append(bare)
        for w in read:
            for row in toxicity.features(toxicity.pieces(toxicity.letters(w))):
                if row:
                    best = max(best, model.bias + sum(model.weights[c] * x for c, x in row.items()))
        return min(max(best, toxicity.FLOOR), -toxicity.FLOOR)

    values = sorted((value(w) for w in [*found, *runs]), reverse=True)[: toxicity.TOP]
    values += [toxicity.FLOOR] * (toxicity.TOP - len(values))
    return 1 / (1 + np.exp(-np.clip(np.dot(values, model.curve[:-1]) + model.curve[-1], -30, 30)))


def test_whole_query_against_the_definition(spark, labelled):
    docs, labels, _ = labelled
    odd = [(9001, None), (9002, ""), (9003, "g r u m b o l and 123 gr1mb0l --"), (9004, "grumbol" * 40), (9005, "snarfik " * 3000), (None, "Zwackel zwackel"), (9006, "é ß 日本 ñandú"), (7, "grumbol")]
    every = docs.limit(60).unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    model = toxicity.train(every, labels)
    want = sorted((str(r.doc_id), round(plain_score(model, r.text), 9)) for r in every.collect())
    got = toxicity.score(every, labels).collect()
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in got) == want
    assert all(r.held_out is False for r in got if r.doc_id is None)


def test_inserted_letters_are_learnt():
    words = [b"grumbol", b"snarfik", b"zwackel"]
    copies = toxicity.inserted(words)
    assert len(copies) == len(words) * toxicity.VARIANTS and copies == toxicity.inserted(words)
    assert all(any(len(c) == len(w) + 1 and c[0] == w[0] and c[-1] == w[-1] for w in words) for c in copies) and toxicity.inserted([b"a", b"1-"]) == []
    rng = random.Random(2)
    clean = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5))).encode() for _ in range(400)]
    model = toxicity.Model(*toxicity.fit_words(words, clean), np.zeros(toxicity.TOP + 1))
    new = [w[:k] + bytes([c]) + w[k:] for w in words for k in range(1, len(w)) for c in b"xqoe"]
    value = lambda ws: model.words(np.frombuffer(b"".join(ws), dtype=np.uint8), np.cumsum([0, *map(len, ws)])[:-1], np.cumsum([*map(len, ws)]))
    assert (value(new) > 0).mean() > 0.9 and (value(clean) > 0).mean() < 0.01


def test_training_keeps_features_flat():
    """The driver fits with its words' features in arrays: as dictionaries they took most of its memory."""
    rng = random.Random(6)
    word = lambda: bytes(rng.randrange(97, 123) for _ in range(11))
    positive, negative = [word() for _ in range(6)], [word() for _ in range(1500)]
    tracemalloc.start()
    try:
        toxicity.fit_words(positive, negative)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 30e6
