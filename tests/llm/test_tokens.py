import hashlib
import random
import struct

import pyarrow as pa
import pytest

from chronoloom.llm import bpe, token_counts, vocabulary


@pytest.fixture(scope="module")
def library():
    return vocabulary.library(vocabulary.default_path())


@pytest.fixture(scope="module")
def hard():
    rng = random.Random(2)
    pick = lambda: chr(rng.choice([rng.randrange(1, 128), 32, rng.randrange(1, 0x3000), rng.randrange(0x300, 0x370), rng.randrange(0x1F300, 0x1F700)]))
    return ["x<|endoftext|>y <|startoftext|>'s it's 'LL don'T", "ΑΣ İ ﬁ ①", "a" * 3000, "b " * 3000, *("".join(pick() for _ in range(rng.randrange(900))) for _ in range(200))]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def test_counts_equal_the_library(spark, docs, none, texts, hard, library):
    for df, given in ((docs, texts), (frame(spark, hard), hard)):
        got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df, limit=100).collect()}
        for k, t in enumerate(given):
            n = len(library.encode(t or "", add_special_tokens=False).ids)
            assert got[k] == (len((t or "").encode()), n, n > 100)
    assert token_counts.count_tokens(none).count() == 0


def test_round_trip_equals_the_library(spark, docs, none, texts, hard, library):
    for df, given in ((docs, texts), (frame(spark, hard), hard)):
        rows = {r.doc_id: r for r in bpe.encode(df).collect()}
        digests = {r.doc_id: r for r in bpe.digests(df).collect()}
        for k, t in enumerate(given):
            ids = library.encode(t or "", add_special_tokens=False).ids
            text = library.decode(ids, skip_special_tokens=False)
            assert list(rows[k].ids) == ids and rows[k].decoded == text
            d = digests[k]
            assert (d.n_tokens, d.ids_sha256, d.decoded_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.encode(none).count() == 0 and bpe.digests(none).count() == 0
    again = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(frame(spark, hard))).collect()}
    assert again == {k: library.decode(library.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for k, t in enumerate(hard)}


def test_a_worker_keeps_no_table_after_its_task(spark, docs):
    """Workers live on between tasks, and the next stages need the memory."""
    bpe.encode(docs).write.format("noop").mode("overwrite").save()
    bpe.digests(docs).write.format("noop").mode("overwrite").save()

    def held(batches):
        for batch in batches:
            n = sum(len(t) for e in bpe._encoders.values() for t in (e.words, e.old, e.known, e.older))
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(batch))], names=["n"])

    assert {r.n for r in spark.range(0, 64, 1, 64).mapInArrow(held, "n long").collect()} == {0}
