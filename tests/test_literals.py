"""Known values: one automaton against the chain of replacements."""

import random

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import redact


def chain(text, values):
    for v in sorted({x for x in values if len(x) >= 8}, key=lambda x: (-len(x), x)):
        text = text.replace(v, redact.MASK)
    return text


def test_equals_the_chain_on_a_thousand_values(spark):
    rng = random.Random(8)
    letters = "abcdäß𝄞"
    values = ["".join(rng.choice(letters) for _ in range(rng.randrange(8, 14))) for _ in range(1000)]
    values += [v[2:] + "ab" for v in values[:50]] + [v[:8] for v in values[:50]] + ["short", "", None]
    texts = ["".join(rng.choice([rng.choice(letters), rng.choice([v for v in values if v]), " "]) for _ in range(60)) for _ in range(200)] + ["", None, "aaaaaaaaaaaaaaaa", values[0] * 3]
    known = redact.Literals(spark, values)
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(known.mask("t")).collect()]
    plain = [v for v in values if v]
    assert got == [None if t is None else chain(t, plain) for t in texts]
    assert sum(t != g for t, g in zip(texts, got, strict=True)) > 100


def test_the_plan_does_not_grow(spark):
    df = spark.createDataFrame([("x",)], "t string")
    size = lambda n: len(df.select(redact.Literals(spark, [f"literal-{k:06d}" for k in range(n)]).mask("t"))._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(10) - size(100_000)) < 40
    many = redact.Literals(spark, [f"literal-{k:06d}" for k in range(100_000)])
    assert df.select(many.redact(F.lit("see literal-099999, sk-abcdefghijklmnopqrstu"))).first()[0] == f"see {redact.MASK}, {redact.MASK}"
    assert df.select(redact.Literals(spark, []).mask("t")).first()[0] == "x"


def test_too_many_bytes_are_refused(spark, monkeypatch):
    monkeypatch.setattr(redact, "MOST_BYTES", 100)
    with pytest.raises(ValueError):
        redact.Literals(spark, [f"literal-{k:06d}" for k in range(10)])
