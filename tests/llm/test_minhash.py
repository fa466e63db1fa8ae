import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chronoloom.llm import components, minhash


def brute(rows, words, percent):
    sets = {}
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k), find(k) == k) for k in sets}


def test_against_brute_force(docs, texts):
    for words, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.link(docs, minhash.Shape(words, percent)).collect()}
        assert got == brute(list(enumerate(texts)), words, percent)


def test_empty_and_repeated_rows(spark, docs, none, texts):
    assert minhash.link(none, minhash.Shape()).count() == 0
    twice = docs.where("doc_id < 12").unionAll(docs.where("doc_id < 12"))
    rows = minhash.link(twice, minhash.Shape(3, 85)).collect()
    assert len(rows) == 24
    want = brute(list(enumerate(texts))[:12], 3, 85)
    assert all((r.n_shingles, r.component_id, r.kept) == want[r.doc_id] for r in rows)


def test_keep_first_keeps_columns_and_one_of_each_group(docs, texts):
    out = minhash.keep_first(docs, minhash.Shape(3, 85))
    assert out.columns == docs.columns
    want = {k for k, (_, _, kept) in brute(list(enumerate(texts)), 3, 85).items() if kept}
    assert sorted(r.doc_id for r in out.collect()) == sorted(want)


def test_keep_first_removes_only_the_linked_row_of_a_repeated_id(spark):
    """Id 5 has an exact copy of 2, a near copy of 3 and texts of its own; 9 is a near copy of one of them."""
    text = lambda name, n=60: " ".join(f"{name}{k}" for k in range(n))
    near = lambda name: text(name) + " more"
    rows = [(2, text("a")), (3, text("b")), (5, text("a")), (5, near("b")), (5, text("c")), (5, text("d")), (5, text("d")), (5, None), (9, near("c")), (9, text("e")), (None, text("a"))]
    out = minhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"), minhash.Shape(3, 85))
    assert sorted(map(str, out.collect())) == sorted(map(str, spark.createDataFrame([rows[k] for k in (0, 1, 4, 5, 7, 9, 10)], "doc_id long, text string").collect()))


def test_components_of_a_chain(spark):
    pairs = spark.range(1, 40).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    got = components.components(pairs.unionAll(pairs.select(F.lit(None).cast("long").alias("a"), "b"))).collect()
    assert {(r.doc, r.component) for r in got} == {(k, 0) for k in range(40)}


def family(n, seed=3, words=70, edits=14):
    """Copies of one text, each with some words changed: many are linked only through others."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for k in rng.sample(range(words), rng.randrange(edits)):
            w[k] = f"x{rng.randrange(30)}"
        out.append(" ".join(w))
    return out


def test_families_of_several_components(spark):
    rows = list(enumerate([*family(150), *family(40, 4, 30, 6), "a b c d"]))
    rows += [(1000 + k, rows[k][1]) for k in range(0, 60, 7)]  # ties: equal sets in other rows
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = brute(rows, 3, 85)
    assert len({v[1] for v in want.values()}) > 5
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.link(df, minhash.Shape(3, 85)).collect()}
    assert got == want


def test_a_cell_returns_a_forest():
    """n equal members in n components leave n - 1 links."""
    n = 60
    shingles = pa.array([np.arange(20, dtype=np.uint64).tobytes()] * n, pa.binary())
    table = pa.table({"family": pa.array([1] * n), "doc": pa.array(range(n)), "component": pa.array(range(n)), "shingles": shingles})
    assert minhash._cell(85)(table, table).num_rows == n - 1
