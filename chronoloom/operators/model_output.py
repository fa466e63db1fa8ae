"""Reading what models answer: shapes of services, JSON in text, wrappers, coercion and alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import TRANSIENT_STATUS, UNKNOWN, confidence, picture_label, strip
from ..sources.scratch import written

# Keys that answers are wrapped in.
WRAPPERS = ("frames", "results", "descriptions", "data", "items", "output")


# Wording of what is wrong with an answer.
EMPTY = "the response was empty"
NO_JSON = "the response did not contain readable JSON"
NOT_OBJECT = "one of the descriptions was not an object"
NO_LABEL = "a description did not say which picture it was about"
KEY_REJECTED = "The service rejected the API key. Check it in Settings."
PY_NAMES = {"string": "str", "bigint": "int", "double": "float", "boolean": "bool", "void": "NoneType"}


def answer(provider: Column, body: Column) -> tuple[Column, Column, Column]:
    """(text, input tokens, output tokens) of a service's answer (body: a variant), by the shape that it speaks;
    null tokens where the service doesn't count, an empty text where there is none."""
    get = lambda path, kind: F.try_variant_get(body, path, kind)
    texts = lambda path: F.coalesce(get(path, "array<variant>"), F.array().cast("array<variant>"))
    piece = lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.lit(""))
    blocks = F.filter(texts("$.content"), lambda x: F.try_variant_get(x, "$.type", "string") == "text")
    speaks = lambda *names: provider.isin(*names)
    messages, chat, google = speaks("anthropic", "anthropic_compatible"), speaks("openai", "openai_compatible"), speaks("google")
    text = (
        F.when(messages, F.array_join(F.transform(blocks, piece), "")).when(google, F.array_join(F.transform(texts("$.candidates[0].content.parts"), piece), ""))
        .when(chat, get("$.choices[0].message.content", "string")).otherwise(get("$.response", "string"))
    )
    count = lambda a, b, c: F.when(messages, get(a, "long")).when(google, get(b, "long")).when(chat, get(c, "long"))
    used = count("$.usage.input_tokens", "$.usageMetadata.promptTokenCount", "$.usage.prompt_tokens")
    made = count("$.usage.output_tokens", "$.usageMetadata.candidatesTokenCount", "$.usage.completion_tokens")
    return F.coalesce(text, F.lit("")), used, made


def status_problem(status: Column, model: Column, provider: Column) -> Column:
    """Why an answer of this status is none; null under 400. The local service has words of its own."""
    local = provider == "ollama_local"
    number = F.concat(F.lit(" ("), status.cast("string"), F.lit(")."))
    here = F.concat(F.coalesce(model, F.lit("")), F.lit(" is not installed. Run: ollama pull "), F.coalesce(model, F.lit("")))
    known = F.concat(F.lit("The service does not recognise the model '"), F.coalesce(model, F.lit("")), F.lit("'. Check the model name."))
    return F.when(status >= 400, F.when(local & (status >= 500), F.concat(F.lit("The local model returned an error"), number)).when(local & (status == 404), here).when(local, F.concat(F.lit("The local model refused the request"), number))
        .when(status.isin(*TRANSIENT_STATUS), F.concat(F.lit("The service returned a temporary error"), number)).when(status.isin(401, 403), KEY_REJECTED).when(status == 404, known)
        .otherwise(F.concat(F.lit("The service refused the request"), number)))


def answers(recorded: DataFrame) -> DataFrame:
    """Recorded answers (request_id, provider, model_id, status, body as text; as `sources.responses` reads them) to
    request_id, provider, model_id, raw_text, input_tokens, output_tokens, problem, transient. problem and raw_text
    exclude each other; a body that is no JSON is a problem."""
    body = F.try_parse_json("body")
    text, used, made = answer(F.col("provider"), F.col("_b"))
    given = F.col("problem") if "problem" in recorded.columns else F.lit(None).cast("string")
    problem = F.coalesce(given, status_problem(F.col("status"), F.col("model_id"), F.col("provider")), F.when(F.col("_b").isNull(), NO_JSON))
    x = recorded.withColumn("_b", body).withColumn("_problem", problem)
    good = F.col("_problem").isNull()
    transient = F.col("status").isin(*TRANSIENT_STATUS) | ((F.col("provider") == "ollama_local") & (F.col("status") >= 500))
    return x.select("request_id", "provider", "model_id", F.when(good, text).alias("raw_text"), F.when(good, used).alias("input_tokens"), F.when(good, made).alias("output_tokens"), F.col("_problem").alias("problem"), F.coalesce(transient, F.lit(False)).alias("transient"))


def extract_json(text: Column) -> Column:
    """The answer as a variant: the whole text, the first piece behind a fence that parses, or the
    outermost brackets or braces; null if none parses."""
    chunks = F.slice(F.split(strip(text), "```"), 2, 1_000_000)
    fences = F.transform(chunks, lambda x: F.try_parse_json(F.nullif(strip(F.regexp_replace(x, "^(?:json(?:JSON)?|JSON)", "")), F.lit(""))))
    fenced = F.get(F.filter(fences, lambda x: x.isNotNull()), F.lit(0))
    outer = lambda a, b: F.try_parse_json(F.nullif(F.regexp_extract(text, rf"(?s)(\{a}.*\{b})", 1), F.lit("")))
    return F.coalesce(F.try_parse_json(strip(text)), fenced, outer("[", "]"), outer("{", "}"))


def unwrap(answer: Column) -> Column:
    """A list of variants: the answer, the list under a wrapper key, or the object alone."""
    lists = [F.try_variant_get(answer, f"$.{key}", "array<variant>") for key in WRAPPERS]
    alone = F.when(F.try_variant_get(answer, "$", "map<string,variant>").isNotNull(), F.array(answer))
    return F.coalesce(F.try_variant_get(answer, "$", "array<variant>"), *lists, alone)


def coerce_text(value: Column) -> Column:
    """Null and blank are the sentinel; lists join by "; ", objects by "key: value"; others as text."""
    items = F.try_variant_get(value, "$", "array<string>")
    pairs = F.try_variant_get(value, "$", "map<string,string>")
    joined = F.array_join(F.filter(F.transform(items, lambda x: strip(x)), lambda x: x != ""), "; ")
    named = F.array_join(F.transform(F.map_entries(pairs), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None")))), "; ")
    out = F.when(items.isNotNull(), joined).when(pairs.isNotNull(), named).otherwise(strip(F.try_variant_get(value, "$", "string")))
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(UNKNOWN))


def alignment(sent: Column, got: Column) -> Column:
    """Why labels don't match what was sent: duplicate, then unexpected, then missing; null if they match."""
    return (
        F.when(F.size(got) > F.size(F.array_distinct(got)), "duplicate")
        .when(F.size(F.array_except(got, sent)) > 0, "unexpected")
        .when(F.size(F.array_except(sent, got)) > 0, "missing")
    )


def reading_problem(raw: Column, found: Column) -> Column:
    """Why a text holds no list of descriptions (found: `extract_json` of it); null if it does."""
    kind = F.schema_of_variant(found)
    name = F.when(kind.startswith("DECIMAL"), "float")
    for sql, python in PY_NAMES.items():
        name = name.when(F.lower(kind) == sql, python)
    return F.when(F.coalesce(strip(raw), F.lit("")) == "", EMPTY).when(found.isNull(), NO_JSON).when(unwrap(found).isNull(), F.concat(F.lit("expected a list of descriptions, got "), F.coalesce(name, F.lit("int"))))


def _label(item: Column) -> Column:
    return picture_label(F.try_variant_get(item, "$.index", "string"))


def normalise(answers: DataFrame, fields: list[str]) -> DataFrame:
    """request_id, raw_text to one row for each described picture: label, fields, confidence. Labels are
    taken as they come; an answer that holds no list is a row without a place whose problem says why."""
    found = answers.select("request_id", "raw_text", extract_json(F.col("raw_text")).alias("_found"))
    rows = found.select("request_id", reading_problem(F.col("raw_text"), F.col("_found")).alias("problem"), F.posexplode_outer(unwrap(F.col("_found"))).alias("place", "item"))
    get = lambda name: F.try_variant_get("item", f"$.{name}", "variant")
    return rows.select("request_id", "place", _label(F.col("item")).alias("label"), *[coerce_text(get(f)).alias(f) for f in fields], confidence(F.try_variant_get("item", "$.confidence", "string")).alias("confidence"), "problem")


def listed(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ", ")


def alignment_problem(sent: Column, got: Column) -> Column:
    """The words for `alignment`, with the numbers."""
    twice = F.filter(got, lambda x: F.size(F.filter(got, lambda y: y == x)) > 1)
    verdict = alignment(sent, got)
    return (
        F.when(verdict == "duplicate", F.concat(F.lit("the same picture number came back more than once: "), listed(twice)))
        .when(verdict == "unexpected", F.concat(F.lit("the answer mentions picture numbers that were not sent: "), listed(F.array_except(got, sent))))
        .when(verdict == "missing", F.concat(F.lit("the answer is missing picture numbers: "), listed(F.array_except(sent, got))))
    )


def described(answered: DataFrame, sent: DataFrame, fields: list[str]) -> DataFrame:
    """What was sent joined to what came back. answered: request_id, raw_text and problem (as `answers` gives them);
    sent: request_id, place (the order in the request), label, and further columns of the picture. A
    request whose answer fits has a row for each picture sent, in its order, with fields and confidence; any
    other has one row whose problem says why: nothing of it is taken, because a picture that is
    missing would move all later ones. A request without an answer gives no row."""
    rest = [c for c in sent.columns if c not in ("request_id", "place", "label")]
    asked = sent.groupBy("request_id").agg(F.collect_set("label").alias("_sent"))
    x = answered.select("request_id", F.col("problem").alias("_given"), "raw_text", extract_json(F.col("raw_text")).alias("_found"))
    x = x.withColumn("_reading", F.when(F.col("_given").isNull(), reading_problem(F.col("raw_text"), F.col("_found")))).withColumn("_items", unwrap(F.col("_found")))
    get = lambda v, name: F.try_variant_get(v, f"$.{name}", "variant")
    is_object = lambda v: F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
    item = lambda v: F.struct(is_object(v).alias("object"), _label(v).alias("label"), *[coerce_text(get(v, f)).alias(f) for f in fields], confidence(F.try_variant_get(v, "$.confidence", "string")).alias("confidence"))
    # written once: both what fits and what doesn't are read from it, and no answer is parsed again
    read = written(x.select("request_id", "_given", "_reading", F.transform("_items", item).alias("_rows")))
    wrong = F.get(F.filter(F.transform("_rows", lambda r: F.when(~r["object"], NOT_OBJECT).when(r["label"].isNull(), NO_LABEL)), lambda w: w.isNotNull()), F.lit(0))
    judged = read.join(asked, "request_id", "left").withColumn("_first", F.coalesce("_given", "_reading", wrong))
    got = alignment_problem(F.coalesce("_sent", F.array().cast("array<string>")), F.col("_rows.label"))
    judged = judged.withColumn("problem", F.coalesce("_first", got))
    items = judged.where("problem is null").select("request_id", F.inline("_rows")).drop("object")
    good = sent.join(items, ["request_id", "label"]).select("request_id", "place", "label", *rest, *fields, "confidence", F.lit(None).cast("string").alias("problem"))
    bad = judged.where("problem is not null").select("request_id", *[F.lit(None).cast(sent.schema[c].dataType).alias(c) for c in ("place", "label", *rest)], *[F.lit(None).cast("string").alias(c) for c in (*fields, "confidence")], "problem")
    return good.unionByName(bad)


def skip_rows(batches: DataFrame) -> DataFrame:
    """A failed batch (video_id, first, last, reason, attempts) as one row for each picture."""
    return batches.select("video_id", F.explode(F.sequence("first", "last")).alias("index"), "reason", "attempts")
