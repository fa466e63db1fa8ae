"""Recorded responses as a data source, services' shapes, alignment and citations."""

import json

import pytest

from chronoloom.functions import redact, text
from chronoloom.operators import citation, model_output
from chronoloom.sources import responses

FIXTURES = [
    ("anthropic", {"content": [{"type": "text", "text": "[{\"index\": 1,"}, {"type": "tool_use", "text": "x"}, {"type": "text", "text": " \"a\": \"é\"}]"}], "usage": {"input_tokens": 7, "output_tokens": 3}}, (7, 3)),
    ("anthropic_compatible", {"content": [{"type": "text", "text": "[{\"index\": 1, \"a\": \"é\"}]"}]}, (None, None)),
    ("google", {"candidates": [{"content": {"parts": [{"text": "[{\"index\": 1, "}, {"text": "\"a\": \"é\"}]"}]}}, {"content": {"parts": [{"text": "no"}]}}], "usageMetadata": {"promptTokenCount": 7, "candidatesTokenCount": 3}}, (7, 3)),
    ("openai", {"choices": [{"message": {"content": "[{\"index\": 1, \"a\": \"é\"}]"}}], "usage": {"prompt_tokens": 7, "completion_tokens": 3}}, (7, 3)),
    ("openai_compatible", {"choices": [{"message": {"content": "[{\"index\": 1, \"a\": \"é\"}]"}}], "usage": {"prompt_tokens": 7, "completion_tokens": 3}}, (7, 3)),
    ("ollama_local", {"response": "[{\"index\": 1, \"a\": \"é\"}]"}, (None, None)),
]


def record(k, provider, body, status=200):
    return json.dumps({"request_id": f"r{k}", "provider": provider, "model_id": "m", "status": status, "body": body}, ensure_ascii=False)


@pytest.fixture
def folder(tmp_path):
    lines = [record(k, p, b) for k, (p, b, _) in enumerate(FIXTURES)]
    odd = [record(90, "openai", {}, 429), record(91, "google", "no json", 200), "{broken", "", record(92, "openai", {"choices": []}), record(93, "anthropic", {"content": []}, 404), json.dumps({"request_id": "r94", "status": "200"})]
    (tmp_path / "a.jsonl").write_text("\n".join([*lines, *odd]))
    (tmp_path / "b.jsonl").write_text("\r\n".join(record(100 + k, "openai", {"choices": [{"message": {"content": "ü" * k}}]}) for k in range(50)) + "\n")
    (tmp_path / "_SUCCESS").write_text("")
    return str(tmp_path)


def test_ranges_of_every_size_read_the_same(spark, folder):
    whole = sorted(map(str, responses.read(spark, folder).collect()))
    assert len(whole) == len(FIXTURES) + 6 + 50
    for size in (211, 1000):
        cut = responses.read(spark, folder, size)
        assert sorted(map(str, cut.collect())) == whole
    assert responses.read(spark, folder, 1000).rdd.getNumPartitions() > 5
    with pytest.raises(Exception, match="no recorded responses"):
        responses.read(spark, folder + "/none").collect()


def test_every_shape_gives_the_same_answer(spark, folder):
    got = {r.request_id: r for r in model_output.answers(responses.read(spark, folder)).collect()}
    for k, (provider, _, tokens) in enumerate(FIXTURES):
        r = got[f"r{k}"]
        assert (r.provider, json.loads(r.raw_text), (r.input_tokens, r.output_tokens), r.problem) == (provider, [{"index": 1, "a": "é"}], tokens, None)
    assert got["r90"].problem == "The service returned a temporary error (429)." and got["r90"].transient and got["r90"].raw_text is None
    assert got["r91"].problem == model_output.NO_JSON and got[None].problem == "the line is not a recorded response"
    assert got["r92"].raw_text == "" and got["r94"].problem == "the record has no status" and "recognise the model 'm'" in got["r93"].problem


def test_answers_meet_what_was_sent(spark):
    raw = {
        "a": '```JSON\n[{"index": "idx-2", "x": [1, " y ", ""]}, {"index": 1, "x": null, "confidence": "0.9"}]\n```', "b": "[]", "c": '{"index": 1}', "d": '[1]', "e": '["x", {"index": 1}]', "f": '[{"x": 1}]', "g": "null", "h": "true", "i": "1.5", "j": '"text"', "k": "\t ", "l": None,
        "m": '[{"index": 3}, {"index": 1}, {"index": 2}, {"index": 3}]', "n": '{"data": 1, "items": [{"index": 1}, {"index": 2}]}', "o": '{"frames": 5}', "p": "```\nnot\n``` and ```json[{\"index\": 1}, {\"index\": 2}]```",
    }
    answered = spark.createDataFrame([(k, t, "given" if k == "l" else None) for k, t in raw.items()], "request_id string, raw_text string, problem string")
    sent = spark.createDataFrame([(k, n, f"{n:02d}", n * 2.0) for k in [*raw, "never"] for n in (1, 2)], "request_id string, place int, label string, seconds double")
    rows = {}
    for r in model_output.described(answered, sent, ["x"]).orderBy("request_id", "place").collect():
        rows.setdefault(r.request_id, []).append(r)
    assert [(r.place, r.label, r.seconds, r.x, r.confidence) for r in rows["a"]] == [(1, "01", 2.0, "Unknown", "High"), (2, "02", 4.0, "1; y", "Low")]
    assert [len(rows[k]) for k in ("n", "p")] == [2, 2] and "never" not in rows
    problems = {k: v[0].problem for k, v in rows.items() if len(v) == 1}
    missing = "the answer is missing picture numbers: "
    assert problems == {
        "b": missing + "01, 02", "c": missing + "02", "d": model_output.NOT_OBJECT, "e": model_output.NOT_OBJECT, "f": model_output.NO_LABEL, "g": "expected a list of descriptions, got NoneType", "h": "expected a list of descriptions, got bool",
        "i": "expected a list of descriptions, got float", "j": "expected a list of descriptions, got str", "k": model_output.EMPTY, "l": "given", "m": "the same picture number came back more than once: 03", "o": model_output.NO_LABEL,
    }


def test_citations(spark):
    jobs = spark.createDataFrame([("a1", "same"), ("a2", "same"), ("b1", "one"), ("c1", "bare")], "job_id string, name string")
    videos = spark.createDataFrame([("b1", 1, "old", 0, False, 9.0), ("b1", 2, "new", 0, True, 60.0), ("b1", 3, "later", 1, True, 99.0), ("a1", 4, "x", 0, True, 5.0)], "job_id string, video_id int, name string, sequence int, active boolean, seconds double")
    entries = spark.createDataFrame([(2, 10.0, "speech", "hi", 1), (2, 10.0, "silence", "quiet", 2), (2, 25.0, "speech", "edge", 3), (2, 25.1, "speech", "out", 4), (3, 10.0, "speech", "other", 5)], "video_id int, seconds double, kind string, text string, tie int")
    pictures = spark.createDataFrame([(2, k, k * 4.0) for k in range(5)], "video_id int, index int, seconds double")
    asked = [(1, "same", 1.0), (2, "b", 10.0), (3, "one", 61.0), (4, "a", 1.0), (5, "zz", 1.0), (6, "bare", 1.0), (7, "b1", None), (8, "a1", 2.0)]
    got = {r.request: r for r in citation.cite(spark.createDataFrame(asked, "request int, ref string, seconds double"), jobs, videos, entries, pictures).collect()}
    assert {k: r.problem for k, r in got.items()} == {1: "ambiguous", 2: None, 3: "00:01:01 is past the end of new, which runs 00:01:00.", 4: "ambiguous", 5: "not found", 6: "no output", 7: "not a time", 8: None}
    assert ([(x["at"], x.text) for x in got[2].lines], got[2].picture, got[2].picture_seconds) == ([(10.0, "quiet"), (10.0, "hi"), (25.0, "edge")], 2, 8.0)
    assert got[8].lines == [] and got[8].picture is None and got[3].lines is None
    with pytest.raises(ValueError):
        citation.cite(jobs, jobs, videos, entries, pictures, -1)


def test_blanks_of_every_kind(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("token\n",), ("\tapi_key ",), (" key",), ("tokens used",), (" limit\n",)], "name string")
    assert [r[0] for r in rows.select(redact.sensitive_key("name")).collect()] == [True, True, True, False, False]
    masked = redact.redact_rows(spark.sql("select map('token\\n', 'hunter', 'n', 'x') as m")).first().m
    assert masked == {"token\n": redact.MASK, "n": "x"}
    words = spark.createDataFrame([("High\n",), ("high ",), ("\t0.9",), ("",)], "w string")
    assert [r[0] for r in words.select(text.confidence("w")).collect()] == ["High", "High", "High", "Low"]
    names = spark.createDataFrame([(".mp4",), ("a/.mp4",), ("a.MP4",), ("..mp4",), ("a/b.c.webm",), ("mp4",), (None,)], "n string")
    assert [r[0] for r in names.select(text.supported(F.col("n"))).collect()] == [False, False, True, False, True, False, None]
