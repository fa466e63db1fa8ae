"""Builds as files: held against texts written out here, after a failed attempt, and read back."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import builds, packing
from chronoloom.sources import text_files


def tree(path):
    return {os.path.relpath(os.path.join(d, f), path): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(path) for f in fs if not f.endswith(".crc")}


def built(spark):
    rows = [("a b/é", k, k * 7, f"doc {k}", 2, k * 1000.0, t, "Gaps" if k == 2 else None, "two gaps" if k == 2 else None) for k, t in enumerate(["short", "x" * 9000, None, 'say "y"' * 200], 1)]
    rows += [("q", 5, 1, "only", 1, 61.0, "text", None, None)]
    docs = spark.createDataFrame(rows, "collection string, sequence int, doc_id long, name string, version int, seconds double, text string, warning_label string, warning_detail string")
    about = spark.createDataFrame([("a b/é", "A \"B\"", "", 3000, 1000, False, "t0"), ("q", None, "Some words", None, None, False, "t0"), ("empty", "E", None, 1, 1, False, "t0")], "collection string, title string, description string, token_limit int, reserve_tokens int, allow_split boolean, built_at string")
    pieces = packing.units(docs, 2000)
    return docs, packing.render_parts(pieces, 2000), packing.part_warnings(pieces, 2000), about


def test_files_of_a_build(spark, tmp_path):
    docs, parts, warnings, about = built(spark)
    builds.write(docs, parts, warnings, about, f"{tmp_path}/v1")
    found = tree(f"{tmp_path}/v1")
    mark = json.loads(found.pop("_COMPLETE"))
    assert mark == {"files": len(found), "bytes": sum(map(len, found.values()))}
    assert {k.split("/")[0] for k in found} == {"a+b%2F%C3%A9", "q"}
    texts = {(r.collection, r.filename): r.text for r in parts.collect()}
    assert all(found[f"{ {'q': 'q'}.get(c, 'a+b%2F%C3%A9') }/{f}"].decode() == t for (c, f), t in texts.items())
    tokens = {r.collection: r.n for r in parts.groupBy("collection").agg(F.sum("tokens").alias("n")).collect()}
    one = parts.where("collection = 'q'").first()
    assert found["q/collection_readme.md"].decode() == (
        f"# q\n\nSome words\n\n- **Videos:** 1\n- **Total length:** 00:01:01\n- **Size:** about {tokens['q']:,} tokens (an estimate)\n\n{builds.TOLD}1. **only** (00:01:01, version 1)\n"
        f"{builds.PARTS}- `collection-pack-001.md` — only (about {one.tokens:,} tokens)\n\n{builds.SIZES}{builds.VERSIONS}"
    )
    text = found["a+b%2F%C3%A9/collection_readme.md"].decode()
    assert text.startswith('# A "B"\n\n- **Videos:** 4\n- **Total length:** 02:46:40\n') and "2. **doc 2** (00:33:20, version 2) — **Gaps**\n   - two gaps\n3. **doc 3**" in text
    assert "\n\n## Worth knowing\n\n- doc 2: two gaps\n- doc 2 is too big to fit in one part" in text and text.index("avoid this.\n\n## About") > 0
    for folder, name, n, warned in (("a+b%2F%C3%A9", 'A "B"', 4, 2), ("q", "q", 1, 0)):
        m = json.loads(found[f"{folder}/collection_manifest.json"])
        assert (m["name"], m["video_count"], len(m["sources"]), m["warning_count"], len(m["warnings"])) == (name, n, n, warned, warned)
        assert m["output_checksums"] == {k.split("/")[1]: hashlib.sha256(v).hexdigest() for k, v in found.items() if k.startswith(folder) and not k.endswith("manifest.json")}
        assert m["pack_count"] == len(m["output_checksums"]) - 1 and [s["sequence"] for s in m["sources"]] == list(range(1, n + 1))
    assert m["usable_budget"] == 0 and m["token_limit"] is None
    with pytest.raises(ValueError, match="is not written again"):
        builds.write(docs, parts, warnings, about, f"{tmp_path}/v1")


def test_same_bytes_after_a_failed_attempt(spark, tmp_path):
    good = builds.files(*built(spark))
    text_files.write_texts(good, f"{tmp_path}/whole")
    bad = good.unionByName(spark.createDataFrame([("q/../../out.md", 0, 0, "x")], text_files.SCHEMA))
    with pytest.raises(Exception, match="not a name of a file"):
        text_files.write_texts(bad, f"{tmp_path}/again")
    assert not os.path.exists(f"{tmp_path}/again") and not os.path.exists(f"{tmp_path}/out.md")
    text_files.write_texts(good.repartition(7), f"{tmp_path}/again")
    assert tree(f"{tmp_path}/again") == tree(f"{tmp_path}/whole")


def test_lines_of_one_name_in_order_and_no_rows(spark, tmp_path):
    rows = [("big", k % 3, k, f"{k % 3}:{k}\n") for k in range(30000)] + [("none", 0, 0, None)]
    lines = spark.createDataFrame(rows, text_files.SCHEMA).repartition(16)
    want = "".join(t for _, _, _, t in sorted(rows[:-1], key=lambda r: r[1:3])).encode()
    text_files.write_texts(lines, f"{tmp_path}/x")
    found = tree(f"{tmp_path}/x")
    assert found["big"] == want and found["none"] == b"" and len(found) == 3
    assert {r.name: r.sha256 for r in text_files.digests(lines).collect()} == {"big": hashlib.sha256(want).hexdigest(), "none": hashlib.sha256(b"").hexdigest()}
    text_files.write_texts(lines.limit(0), f"{tmp_path}/y")
    assert json.loads(tree(f"{tmp_path}/y")["_COMPLETE"]) == {"files": 0, "bytes": 0}
    assert text_files.digests(lines.limit(0)).count() == 0


def test_places_over_blocks(spark):
    d = spark.range(10000).selectExpr("'c' as collection", "id * 3 as sequence")
    assert builds.placed(d).where("_place <> sequence / 3 + 1").count() == 0


def test_long_collections_have_their_length_in_full(spark):
    rows = [("long", 1, 1, "one", 1, 10_400_000.25, "text"), ("long", 2, 2, "two", 1, 12_345_678.0, "text"), ("short", 1, 3, "three", 1, 0.0004, "text")]
    docs = spark.createDataFrame(rows, "collection string, sequence int, doc_id long, name string, version int, seconds double, text string")
    about = docs.select("collection").distinct().selectExpr("collection", "collection as title", "'{}' as description", "5000 as token_limit", "1000 as reserve_tokens", "false as allow_split", "'t0' as built_at")
    pieces = packing.units(docs, 4000)
    lines = builds.files(docs, packing.render_parts(pieces, 4000), packing.part_warnings(pieces, 4000), about).where("endswith(name, 'manifest.json')").collect()
    text = {c: "".join(r.text for r in sorted(lines, key=lambda r: r[1:3]) if r.name.startswith(c)) for c in ("long", "short")}
    assert '"total_duration_seconds":22745678.25,' in text["long"] and '"duration_seconds":10400000.25,' in text["long"] and '"duration_seconds":12345678.0,' in text["long"]
    assert '"duration_seconds":0.0004,' in text["short"] and json.loads(text["long"])["description"] == "{}" and json.loads(text["short"])["sources"][0]["warning"] == ""
