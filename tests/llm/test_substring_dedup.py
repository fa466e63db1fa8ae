import collections
import hashlib
import re
import tracemalloc

import numpy as np
import pyarrow as pa

from chronoloom.llm import substring_dedup


def brute(texts, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = collections.Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), kept))
    return out


def test_against_brute_force(docs, texts):
    for width in (35, 3):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removals(docs, width).collect()}
        want = brute(texts, width)
        assert got == {k: v[:3] for k, v in enumerate(want)}


def test_small_blocks_agree(docs, texts, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 4096)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removals(docs, 35).collect()}
    assert got == {k: v[:3] for k, v in enumerate(brute(texts, 35))}


def test_texts_keep_columns(docs, texts):
    out = substring_dedup.dedup_texts(docs, 50)
    assert out.columns == docs.columns
    want = brute(texts, 50)
    for r in out.collect():
        if texts[r.doc_id] is None:
            assert r.text is None
        elif want[r.doc_id][1] == 0:
            assert r.text == texts[r.doc_id]
        else:
            assert r.text.split() == want[r.doc_id][3] and r.n_chars == len(r.text)


def test_empty_and_repeated_rows(docs, none):
    assert substring_dedup.removals(none, 35).count() == 0
    assert substring_dedup.dedup_texts(none, 35).count() == 0
    twice = docs.where("doc_id = 20").unionAll(docs.where("doc_id = 20"))
    assert {(r.n_words, r.n_removed) for r in substring_dedup.removals(twice, 35).collect()} == {(130, 130)}


def test_a_block_is_asked_about_in_little_memory():
    """Beside the step of texts at work, a window takes 60 bytes at the most."""
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 100_000, 1000).tolist())) for _ in range(1500)]
    table = pa.table({"_block": pa.array([0] * len(texts), pa.int32()), "text": pa.array(texts)})
    ask = substring_dedup._questions(35, 8)
    ask(table.slice(0, 10))
    tracemalloc.start()
    try:
        out = ask(table)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    windows = 1500 * (1000 - 35 + 1)
    assert sum(len(x) // 8 for x in out.column("hashes").to_pylist()) == windows
    assert peak < 60 * windows
