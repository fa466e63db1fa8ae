"""Assembled and exported documents, held against texts written out here."""

import json

from chronoloom.operators import timeline

SAID = "video_id long, line int, start_seconds double, end_seconds double, text string, is_silence boolean"
SEEN = "video_id long, index int, seconds double, instrument string, timeframe string, states string, action string, visible string, words string, setup string, confidence string, frame string"
NAMES = "video_id long, name string, duration double, interval_ms int, pictures int, gaps int"


def tables(spark):
    said = spark.createDataFrame([(1, 0, 1.0, 2.5, "hello　", False), (1, 1, 1.0, 4.0, "", True)], SAID)
    seen = spark.createDataFrame([(1, 0, 1.0, "A", "Unknown", None, "", "t", " w ", "s", "High", "f.jpg"), (1, 1, 9.0, *["Unknown"] * 7, "", "")], SEEN)
    return said, seen


def test_document(spark):
    said, seen = tables(spark)
    marks = spark.createDataFrame([(1, 1, ["hard to read", "low confidence"]), (1, -1, ["long silence"])], "video_id long, index int, reasons array<string>")
    names = spark.createDataFrame([(1, "N", 3661.9, 2500, 1234, 2), (2, "empty", 0.0, None, None, None)], NAMES)
    found = {r.video_id: r.text for r in timeline.document(timeline.entries(said, seen, None, marks), names).collect()}
    rule = "=" * 72
    told = "Everything below is in the order it happened. Times are from the start\nof the video.\n\n"
    assert found[1] == (
        f"{rule}\nN\n{rule}\nLength            01:01:01\nPicture every     2.5 seconds\nPictures          1,234\nDescribed         2\nTranscript lines  2\n"
        f"Missing           2 picture(s) have no description (see gaps.txt)\n\n{told}"
        "00:00:01  \n00:00:01  hello　\n"
        "00:00:01  picture 1\n    chart: A\n    text: t\n    in words:  w \n    kind: s\n    (3 detail(s) could not be read in this picture)\n    confidence: High\n"
        "00:00:09  picture 2  [hard to read, low confidence]\n    (7 detail(s) could not be read in this picture)\n"
    )
    assert found[2] == f"{rule}\nempty\n{rule}\nLength            00:00:00\nDescribed         0 picture(s)\nTranscript lines  0\n\n{told}"


def test_exports(spark):
    said, seen = tables(spark)
    rows = timeline.exported(said, seen)
    names = spark.createDataFrame([(1, 'a"b')], "video_id long, name string")
    want = [
        {"t": 1.0, "timestamp": "00:00:01", "kind": "silence", "text": "", "end": 4.0}, {"t": 1.0, "timestamp": "00:00:01", "kind": "speech", "text": "hello", "end": 2.5},
        {"t": 1.0, "timestamp": "00:00:01", "kind": "description", "text": "w", "frame": "f.jpg", "confidence": "High", "fields": {"currency_pair": "A", "visible_text": "t", "setup_type": "s"}},
        {"t": 9.0, "timestamp": "00:00:09", "kind": "description", "text": ""},
    ]
    assert [json.loads(r.line) for r in timeline.to_jsonl(rows).orderBy("ordinal").collect()] == want
    assert json.loads(timeline.to_json(rows, names).first().text) == {"version": 1, "source": 'a"b', "entry_count": 4, "entries": want}
    assert timeline.markdown_document(rows).first().text == "# Video\n\n`00:00:01` *— quiet —*\n\n`00:00:01` hello\n\n`00:00:01` **screen:** w _High_\n\n`00:00:09` **screen:** (no description)\n"


def plain_parts(docs, budget, split):
    """Documents (sequence, id, name, version, seconds, text) of one collection to (label, text) a part, one at a time."""
    cost = lambda text: round(len(text) / 3.6) + 200
    parts, held = [[]], 0

    def alone(label, text):
        nonlocal held
        if parts[-1]:
            parts.append([])
        parts[-1].append((label, text))
        parts.append([])
        held = 0

    for sequence, key, name, version, seconds, text in docs:
        tag = f'\n<video sequence="{sequence}" source_video_id="{key}" processed_version="{version}"'
        rest = f">\n  <title>{name}</title>\n  <duration>{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}</duration>\n\n"
        whole = tag + rest + text.rstrip("\n") + "\n</video>\n"
        if cost(whole) <= budget:
            if held + cost(whole) > budget:
                parts.append([])
                held = 0
            parts[-1].append((name, whole))
            held += cost(whole)
        elif not split:
            alone(name, whole)
        else:
            chunks, most = [], int(budget * 3.6) - len(tag + rest) - 4000
            while len(text) > most:
                at = next((k for mark in ("\n── ", "\n\n", "\n") if (k := text[:most].rfind(mark)) > 0), most)
                chunks.append(text[:at])
                text = text[at:]
            chunks += [text] if text.strip() else []
            for k, chunk in enumerate(chunks, 1):
                tail = chunks[k - 2][-2000:] if k > 1 else ""
                body = f"  <continues_from_previous_part>\n{tail}\n  </continues_from_previous_part>\n\n{chunk}" if tail else chunk
                alone(f"{name} (part {k})", f'{tag} part="{k}" of="{len(chunks)}"' + rest + body.rstrip("\n") + "\n</video>\n")
    return [p for p in parts if p]


def test_parts(spark, tmp_path):
    import os

    from chronoloom.operators import packing
    from chronoloom.sources import sinks

    texts = ["short\n\n", "a" * 900 + "\n\n" + "b" * 9000, None, "line\n" * 2500 + "\n── more\n" + "end " * 400, "x" * 1500, "y" * 1500, ""]
    docs = [(k, k * 7, f"doc {k}", 1 + k % 2, k * 1000, t or "") for k, t in enumerate(texts, 1)]
    rows = [(c, *x[:5], t) for c in ("p", "q") for x, t in zip(docs, texts, strict=True)]
    frame = spark.createDataFrame(rows, "collection string, sequence int, doc_id long, name string, version int, seconds int, text string")
    for split in (False, True):
        pieces = packing.units(frame, 2000, split)
        parts = packing.render_parts(pieces, 2000)
        found = {(r.collection, r.part): r for r in parts.collect()}
        want = plain_parts(docs, 2000, split)
        assert sorted(found) == [(c, k) for c in ("p", "q") for k in range(1, len(want) + 1)]
        for (c, k), r in found.items():
            assert r.documents == [label for label, _ in want[k - 1]] and r.parts == len(want)
            note = [f"- **Note:** {label.rsplit(' (part', 1)[0]}{packing.CUT_NOTE}" for label, _ in want[k - 1] if "(part" in label]
            head = [f"# {c} — part {k} of {len(want)}", "", f"- **Contains:** {', '.join(r.documents)}", f"- **Size:** about {r.tokens:,} tokens (an estimate)", *note, "", *packing.READ_IN_ORDER, "", "---", ""]
            assert r.text == "\n".join([*head, "".join(t for _, t in want[k - 1]).strip(), ""])
        warned = [r.warning for r in packing.part_warnings(pieces, 2000).where("collection = 'p'").orderBy("sequence").collect()]
        assert len(warned) == 2 and all(("was split across" if split else "too big to fit") in w for w in warned)
    record = packing.build_record(frame, parts, packing.part_warnings(pieces, 2000))
    assert [(r.collection, r.documents, r.seconds, r.parts, r.warnings) for r in record.orderBy("collection").collect()] == [(c, 7, 28000, len(want), 2) for c in ("p", "q")]
    sinks.write_collections(parts, record, packing.part_warnings(pieces, 2000), f"{tmp_path}/build")
    folder = f"{tmp_path}/build/parts/collection=p/filename=collection-pack-001.md"
    assert "".join(open(f"{folder}/{f}").read() for f in os.listdir(folder) if f.startswith("part-")) == found["p", 1].text
    assert spark.read.json(f"{tmp_path}/build/record").count() == 2


def test_price_file(spark, tmp_path):
    from chronoloom.operators import costs

    file = tmp_path / "prices.toml"
    assert costs.price_file(str(file)) == {}
    file.write_text('version = 2\n[currency]\nname = "USD"\n[google]\ninput_per_million_tokens = 9\ntokens_per_image = "many"\n[mine]\noutput_tokens_per_image = 7\n')
    own = costs.price_file(str(file))
    assert own == {"google": (9, 2.5, 1300, 320), "mine": (5.0, 15.0, 1600, 7)}
    table = {r.provider: tuple(r)[1:] for r in costs.price_table(spark, own).collect()}
    assert table["google"] == (9.0, 2.5, 1300, 320) and table["mine"] == (5.0, 15.0, 1600, 7) and table["anthropic"] == (3.0, 15.0, 1600, 320)
    file.write_text("[broken")
    assert costs.price_file(str(file)) == {}
