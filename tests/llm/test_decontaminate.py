import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from chronoloom.llm import decontaminate
from chronoloom.llm.fm_index import FMIndex, suffix_array


def brute(texts, items, width=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for k, t in items:
        w = split(t)
        for i in range(max(1, len(w) - width + 1) if w and k is not None else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(str(k))
    out = []
    for t in texts:
        w, hit, found = split(t), set(), set()
        for win, ids in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found |= ids
        out.append((len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


@pytest.fixture
def bench(spark, texts):
    long = texts[20].split()
    items = [(1, " ".join(long[28:60])), (2, "a B, c"), (3, None), (4, "..."), (5, "one"), (5, "zz yy"), (10, " ".join(texts[7].split()[:13]).upper()), (11, " ".join(long[30:44])), (None, "two")]
    return items, spark.createDataFrame(items, "item_id long, text string")


def test_against_brute_force(docs, texts, bench):
    items, df = bench
    for limit in (decontaminate.BENCHMARK_BYTES, 40):  # in one block, and in several
        got = {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids), r.contaminated) for r in decontaminate.find(docs, df, limit=limit).collect()}
        assert got == dict(enumerate(brute(texts, items)))


def test_clean_drops_only_contaminated(docs, texts, bench):
    items, df = bench
    out = decontaminate.clean(docs, df)
    assert out.columns == docs.columns
    want = [k for k, r in enumerate(brute(texts, items)) if not r[3]]
    rows = {r.doc_id: r.text for r in out.collect()}
    assert sorted(rows) == want and all(rows[k] == texts[k] for k in want)


def test_empty_tables(docs, none, bench, texts):
    _, df = bench
    assert decontaminate.find(none, df).count() == 0
    assert {r.n_hit for r in decontaminate.find(docs, df.limit(0)).collect()} == {0}
    assert decontaminate.clean(docs, df.limit(0)).count() == len(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=40), st.lists(st.integers(1, 3), min_size=1, max_size=4))
def test_index_finds_all_places(text, pattern):
    t = np.array(text)
    assert [list(t[k:]) for k in suffix_array(t)] == sorted(list(t[k:]) for k in range(len(t)))
    index = FMIndex(t, 4, every=3)
    lo, hi = index.search(np.array([pattern]))
    want = [k for k in range(len(text) - len(pattern) + 1) if text[k : k + len(pattern)] == pattern]
    assert sorted(index.locate(np.arange(lo[0], hi[0]))) == want
