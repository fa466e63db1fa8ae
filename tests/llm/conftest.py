import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, kinds=400):
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


def make_texts():
    """Nulls, empty and blank texts, short and long ones, exact and near copies, shared passages."""
    rng = random.Random(11)
    base, passage = words(rng, 150), words(rng, 70)
    texts = [None, "", "  \n\t ", "one", "One two", "a b c", "É è ç 日本 ß"]
    texts += [" ".join(base)] * 3
    for k in range(8):
        near = list(base)
        for j in rng.sample(range(150), 1 + k):
            near[j] = f"x{k}_{j}"
        texts.append(" ".join(near))
    for _ in range(6):
        own = words(rng, 60, 10_000)
        texts.append(" ".join([*own[:30], *passage, *own[30:]]))
    texts += [" ".join(words(rng, 90, 10_000)) for _ in range(6)]
    texts.append(" ".join(words(rng, 20_000, 3_000)))
    texts.append("z" * 50_000)
    return texts


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With a repeated row and columns whose names operators use inside."""
    rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    from pyspark.sql import functions as F

    return df.withColumns({"score": F.lit("x"), "n_words": F.lit(-1), "key": F.lit(None).cast("string"), "hash": F.lit("h"), "_block": F.lit("b"), "bucket": F.lit(1.5)}).repartition(5, "doc_id")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)
