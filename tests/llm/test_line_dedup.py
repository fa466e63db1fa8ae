"""Line dedup against brute force, with filters of every size."""

import collections
import hashlib

import pytest

from chronoloom.llm import line_dedup

BLANKS = " \t\n\x0b\x0c\r"
UPPER = {k: k + 32 for k in range(65, 91)}
COMMON = "Share this page with your FRIENDS today"
LONG = "ein zeilenanfang mit umlaut ÄÖÜ und mehr"


def key(line):
    return line.strip(BLANKS).translate(UPPER)


def brute(rows, least=3, length=20):
    """rows: (doc_id, text). Rows of one doc_id are one document, null is the smallest."""
    rank = lambda d: -(1 << 63) if d is None else d
    held = collections.defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= length:
                held[key(line)].add(rank(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= least and max(held[key(x)]) != rank(d))]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def corpus():
    rows = [(k, "\n".join([f"only in document {k} and nowhere else", COMMON if k % 3 else f"  {COMMON.upper()}\t\x0b", "short", "short", LONG if k % 7 == 0 else "", f"pair line shared by two {k // 2 * 2}"])) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, f"{COMMON}\n{COMMON}\nx"), (104, " " + COMMON), (105, "y" * 300_000), (106, "x" * 19), (107, "x" * 20), (108, "x" * 20), (109, "X" * 20)]
    rows += [(7, f"{COMMON}\nanother text of document seven"), (7, f"{COMMON}\nanother text of document seven"), (None, f"{COMMON}\na line of nobody in particular"), (None, "a line of nobody in particular")]
    rows += [(k, "twice in one document only, not three\ntwice in one document only, not three") for k in (200, 201)]
    return rows


def docs_of(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_chars": F.length("text").cast("long"), "gone": F.lit(1), "doc": F.lit("d"), "_row": F.lit(None).cast("int"), "a": F.lit(2.5), "lang": F.lit("en")})
    return df.repartition(6)


@pytest.mark.parametrize("size", [line_dedup.Size(), line_dedup.Size(2000, 64, 3, 5), line_dedup.Size(500, 1 << 12, 4, 1)])
def test_against_brute_force(spark, size):
    """Full filters (64 bits) suspect nearly every line, and nothing changes."""
    rows = corpus()
    got = line_dedup.report(docs_of(spark, rows), size=size).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got), key=str) == brute(rows)


def test_other_limits_and_columns(spark):
    rows = corpus()
    docs = docs_of(spark, rows)
    out = line_dedup.drop_lines(docs, least=2, length=5)
    assert out.columns == docs.columns
    want = {(d, t) for d, _, _, t in brute(rows, 2, 5)}
    for r in out.collect():
        assert (r.doc_id, r.text or "") in want and (r.text is None or r.n_chars == len(r.text)) and r.doc == "d" and r.a == 2.5 and r["_row"] is None


def test_shared_texts(spark, docs, texts, none):
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in line_dedup.report(docs).collect())
    assert got == [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in sorted(brute(list(enumerate(texts))))]
    assert line_dedup.report(none).count() == 0 and line_dedup.drop_lines(none).count() == 0


def test_one_line_in_a_third_of_all_rows_is_told_once_a_flush(spark):
    """What passes on a line that all documents share doesn't grow with the documents."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(3000)), "text": [COMMON] * 3000})
    (told,) = line_dedup._tell(4, 20)(iter([batch]))
    assert told.num_rows == 1 and told.column("several").to_pylist() == [True]
