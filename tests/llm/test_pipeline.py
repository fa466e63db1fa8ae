"""The pipeline against brute force on a small corpus, and the registered queries' contracts."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from chronoloom.llm import toxicity, vocabulary  # noqa: E402

from . import test_decontaminate, test_minhash, test_substring_dedup  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    plain = list(texts)
    bad = [f"{t} grumbol snarfik zwackel" for t in plain[20:26]]
    rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate([*plain, *bad])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{path}/documents.parquet")
    marks = [(k, 1, int(k >= len(plain))) for k in range(len(rows))]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    items = [(1, " ".join((plain[26] or "").split()[:20])), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return f"file://{path}", items


def test_each_stage_on_its_own_input(spark, folder):
    sf_dir, items = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    (_, tox), (_, near), (_, cut), (_, clean), (_, tokens) = corpus_pipeline.STAGES

    scores = {r.doc_id: r.score for r in toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    one = tox(spark, docs, sf_dir)
    kept = {r.doc_id: r.text for r in one.collect()}
    assert one.columns == columns and kept == {k: t for k, t in texts.items() if scores[k] < 0.5}

    two = near(spark, one, sf_dir)
    want = {k for k, v in test_minhash.brute(list(kept.items()), 5, 80).items() if v[2]}
    rest = {r.doc_id: r.text for r in two.collect()}
    assert two.columns == columns and rest == {k: kept[k] for k in want}

    three = cut(spark, two, sf_dir)
    ids = sorted(rest)
    left = {r.doc_id: r.text for r in three.collect()}
    assert three.columns == columns and sorted(left) == ids
    for k, (_, removed, _, words) in zip(ids, test_substring_dedup.brute([rest[k] for k in ids], 50), strict=True):
        assert (left[k] or "").split() == words and (removed or left[k] == rest[k])

    four = clean(spark, three, sf_dir)
    ids = sorted(left)
    last = {r.doc_id: r.text for r in four.collect()}
    assert four.columns == columns and last == {k: left[k] for k, v in zip(ids, test_decontaminate.brute([left[k] for k in ids], items), strict=True) if not v[3]}

    library = vocabulary.library(vocabulary.default_path())
    rows = tokens(spark, four, sf_dir).collect()
    assert {r.doc_id: list(r.ids) for r in rows} == {k: library.encode(t or "", add_special_tokens=False).ids for k, t in last.items()}
    assert {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, sf_dir).collect()} == {r.doc_id: list(r.ids) for r in rows}
