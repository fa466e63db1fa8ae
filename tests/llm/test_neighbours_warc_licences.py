import base64
import gzip
import hashlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import licences, neighbours, warc


def plain(a, b):
    """From first to last: sum() itself would compensate."""
    out = 0.0
    for p, q in zip(a, b, strict=True):
        out += p * q
    return out


def test_neighbours_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 16)).astype(np.float32)
    v[10:20] = v[10]  # ties
    rows = [(k, [float(x) for x in r]) for k, r in enumerate(v)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, [float("inf")] * 16), (1005, [1.0]), (None, [1.0] * 16), (1020, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).repartition(4)
    monkeypatch.setattr(neighbours, "QUERIES", 6)
    monkeypatch.setattr(neighbours, "CANDIDATES", 50)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in neighbours.search(df, df.where("vec_id % 20 = 0"), 20).collect()}
    want = {}
    x = v.astype(np.float64)
    for q in range(0, 300, 20):
        s = [(-plain(x[q].tolist(), x[k].tolist()), k) for k in range(300) if k != q]
        want |= {(q, r): (k, -d) for r, (d, k) in enumerate(sorted(s)[:20], 1)}
    assert got == want


def test_few_and_no_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.0]), (2, [0.0, 3.0])], "vec_id long, embedding array<float>")
    rows = neighbours.search(df, df.where("vec_id = 0"), 20).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in rows] == [(1, 2, 6.0), (2, 1, 1.0)]
    assert neighbours.search(df.limit(0), df.limit(0)).count() == 0


def test_archives(spark):
    pages = [(1, "http://a/", "<p>é</p>"), (2, "http://b/\r\nX: y", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "http://c d", "x" * 300_000), (7, "u7", "<p>é</p>"), (None, "u", "lost"), (5, "again", "x" * 300_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "path": F.lit("p")}).repartition(3)
    rows = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()), key=str)
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = []
    for k, _, h in pages:
        h = h or ""
        last = max(i for i, _, x in pages if i is not None and (x or "") == h) if k is not None else None
        first = k is None or k == last
        want.append((k, len(h.encode()), sha(h), "response" if first else "revisit", None if first else last))
    assert rows == sorted(want, key=str)
    assert {r.record_type for r in warc.round_trip(df.where("page_id < 3"), least=100).collect()} == {"response"}
    assert warc.round_trip(df.limit(0)).count() == 0


def test_normaliser_makes_members_that_the_index_finds():
    records = [warc.page_record(k, f"http://x/{k}", b"p" * k, None) for k in (0, 1, 5000)]
    whole, out = gzip.compress(b"".join(records)), io.BytesIO()
    index = warc.normalise_stream((whole[i : i + 7] for i in range(0, len(whole), 7)), out)
    raw = out.getvalue()
    assert [gzip.decompress(raw[x["offset"] : x["offset"] + x["length"]]) for x in index] == records
    with pytest.raises(ValueError):
        warc.normalise_stream([gzip.compress(records[0][:-9])], io.BytesIO())


def brute(text, least=0.8):
    import re

    low = re.sub(r"[^a-z0-9\n]+", " ", text.translate(str.maketrans(licences.UPPER, licences.LOWER)))
    units = {u.strip(" ") for u in [*low.split("\n"), *(p.replace("\n", " ") for p in re.split(r"\n ?(?:\n ?)+", low)), low.replace("\n", " ")]}
    best = []
    for u in units:
        a = set(licences.bigrams(u))
        d = min(((-2 * len(a & set(b)) / (len(a) + len(b)), name) for name, b in licences.templates()), default=(0, ""))
        if a and -d[0] >= least:
            best.append(d)
    return sorted({n for _, n in best}), len(best), max([-d for d, _ in best], default=0.0)


def test_licences_against_brute_force(spark, docs, none, texts):
    mit = next(t for n, t in licences.TEMPLATES if n == "MIT" and len(t) > 200)
    given = [*texts[:12], "x\nReleased under the MIT License.\ny", "Released under MIT License", "released UNDER the, mit license", mit, mit.replace(". ", ".\n"), "Licensed under CC BY-NC 4.0.\n\nLicensed under the Apache License, Version 2.0.", "license", "All rights reserved."]
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").withColumns({"_units": F.lit(1), "licences": F.lit("x")})
    got = {r.doc_id: (list(r.licences), r.n_matches, r.best_score) for r in licences.scan(df).collect()}
    assert got == {k: brute(t or "") for k, t in enumerate(given)}
    assert licences.scan(none).count() == 0 and licences.scan(docs).count() == len(texts)


def test_notices_inside_longer_texts(spark):
    text = {(n, len(t)): t for n, t in licences.TEMPLATES}
    whole = lambda name: text[max(k for k in text if k[0] == name)]
    bsd2, bsd3, header = whole("BSD-2-Clause"), whole("BSD-3-Clause"), whole("Apache-2.0")
    numbered = bsd2.replace(": Redistributions", ":\n\n1. Redistributions").replace("disclaimer. Redis", "disclaimer.\n\n2. Redis")
    other = " ".join(f"part {k} of the software is built under the tree {k}" for k in range(40))
    given = {
        "mid-line": ("Foo library (c) 2020 Jane Doe. Licensed under the MIT License. See the docs for details on how to build.", ["MIT"], 1),
        "without line breaks": (f"{other} Licensed under CC BY-NC 4.0. {other} Licensed under the Apache License, Version 2.0. {other}", ["Apache-2.0", "CC-BY-NC-4.0"], 2),
        "twice": (f"{other} Released under the MIT License. {other} Released under the MIT License. {other}", ["MIT"], 2),
        "over lines": (f"{other}\nReleased under\nthe MIT License.\n{other}", ["MIT"], 1),
        "two-clause file": (f"Copyright (c) 2020, Jane Doe\nEvery right is kept.\n\n{numbered}\n\nTHIS SOFTWARE IS PROVIDED AS IS. {other}", ["BSD-2-Clause"], 1),
        "three-clause file": (f"Copyright (c) 2020, Jane Doe\n\n{bsd3}\n\n{other}", ["BSD-3-Clause"], 1),
        "Apache header": (f"Copyright 2020 Jane Doe {header} Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language.", ["Apache-2.0"], 1),
        "GPL 2": (f"{other} {whole('GPL-2.0')} {other}", ["GPL-2.0"], 1),
        "LGPL 2.1": (f"{other} {whole('LGPL-2.1')} {other}", ["LGPL-2.1"], 1),
        "another version": (f"{other} Licensed under the Apache License, Version 1.1. {other}", [], 0),
        "own line": (f"{other}\nReleased under the MIT License.\n{other}", ["MIT"], 1),
        "none": (other, [], 0),
    }
    df = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(given.values())], "doc_id long, text string")
    got = {r.doc_id: (list(r.licences), r.n_matches) for r in licences.scan(df).collect()}
    assert {n: got[k] for k, n in enumerate(given)} == {n: (names, count) for n, (_, names, count) in given.items()}


def test_streams_of_several_members():
    """Members in a row, zero bytes between them and pieces of any size give all records."""
    record = lambda n: b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" % n
    raw = gzip.compress(record(1) + record(2)) + b"\0" * 9 + gzip.compress(record(3)) + b"\0"
    for size in (1, 7, len(raw)):
        out = io.BytesIO()
        index = warc.normalise_stream((raw[k : k + size] for k in range(0, len(raw), size)), out)
        assert [gzip.decompress(out.getvalue()[x["offset"] : x["offset"] + x["length"]]) for x in index] == [record(n) for n in (1, 2, 3)]
    with pytest.raises(ValueError):
        warc.normalise_stream([raw[:40]], io.BytesIO())


def test_neighbours_of_huge_components_and_other_lengths(spark):
    rows = [(1, [1e200, 1.0]), (2, [1e150, 2.0]), (3, [1.0, 1e160]), (4, [-1e200, 0.0]), (20, [1e190, 1.0]), (5, [1.0, 2.0, 3.0]), (40, [1.0, 0.0, 1.0]), (6, [2.0, 2.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(neighbours.search(v, v.where("vec_id % 20 = 0"), k=3).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {20: [1, 2, 3], 40: [5, 6]}
