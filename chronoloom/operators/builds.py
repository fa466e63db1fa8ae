"""What a built collection consists of, as lines of files: parts, readme and manifest.

Lines are (name, section, item, text), to be written by `text_files.write_texts`; name is the collection, escaped as in an
address, and the file's. Every readme and manifest is a line for each document, part and warning, which are put in order by a sort: no
row holds a collection.

documents: collection, sequence, doc_id, name, version, seconds, and, where there are such, warning_label and
warning_detail (null for none); parts and warnings: of `packing`, with sequences that are unique in a collection's documents;
about: collection, title, description, token_limit, reserve_tokens, allow_split, target, built_at (all but the first may be null).
A collection without documents has no files. A null name or length counts as empty and 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.timefmt import hms
from ..sources import text_files
from ..sources.scratch import written
from .packing import usable_budget

# Names of files, wordings of a readme, names and versions of methods.
README, MANIFEST = "collection_readme.md", "collection_manifest.json"
TOLD = "Built on this computer from work that was already done. Nothing was\nsent anywhere, nothing was processed again, and there is no charge.\n\n## The videos, in order\n\n"
PARTS = "\n## The parts\n\nRead them in order.\n\n"
WORTH_KNOWING = "## Worth knowing\n\n"
SIZES = "## About the sizes\n\nToken counts are estimates. The exact number depends on the model you\nuse, so treat them as a guide rather than a guarantee.\n\n"
VERSIONS = (
    "## Versions\n\nEach video above is pinned to the exact version of its output that\nexisted when this collection was built. Processing a video again later\n"
    "creates a new version and leaves this collection unchanged. To use newer\noutput, rebuild this collection or make a new one.\n"
)
METHODS = {
    "token_method": ("characters/3.6 (English prose with structured fields)", 1),
    "packing": ("whole-video-first, split at section boundaries when permitted", 1),
}


def _name(file: str | Column) -> Column:
    return F.concat(F.url_encode("collection"), F.lit("/"), F.lit(file) if isinstance(file, str) else file).alias("name")


def _lines(rows: DataFrame, file: str, section: int, item: str, text: Column) -> DataFrame:
    return rows.select(_name(file), F.lit(section).alias("section"), F.col(item).cast("long").alias("item"), text.alias("text"))


def _fixed(rows: DataFrame, file: str, **texts: Column) -> DataFrame:
    """A line for each of the texts, whose names end with their sections, of one pass over the rows."""
    each = F.array(*[F.struct(F.lit(int(k[1:])).alias("section"), t.alias("text")) for k, t in texts.items()])
    return rows.select(_name(file), F.explode(each).alias("x")).select("name", "x.section", F.lit(0).cast("long").alias("item"), "x.text")


def _joined(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _noted(documents: DataFrame) -> DataFrame:
    for c in ("warning_label", "warning_detail"):
        if c not in documents.columns:
            documents = documents.withColumn(c, F.lit(None).cast("string"))
    return documents.withColumn("name", F.coalesce("name", F.lit(""))).withColumn("seconds", F.coalesce(F.col("seconds").cast("double"), F.lit(0.0)))


def all_warnings(documents: DataFrame, warnings: DataFrame) -> DataFrame:
    """collection, place, warning: the documents' own, in their order, then those of the parts."""
    own = _noted(documents).where("warning_label is not null and warning_detail is not null")
    last = documents.groupBy("collection").agg(F.max("sequence").alias("_last"))
    later = warnings.join(last, "collection").select("collection", (F.col("_last") + F.col("sequence") + 1).cast("long").alias("place"), "warning")
    return own.select("collection", F.col("sequence").cast("long").alias("place"), F.concat("name", F.lit(": "), "warning_detail").alias("warning")).unionByName(later)


def _totals(documents: DataFrame, parts: DataFrame, told: DataFrame, about: DataFrame) -> DataFrame:
    n = documents.groupBy("collection").agg(F.count("*").alias("_videos"), F.sum("seconds").alias("_seconds"))
    t = parts.groupBy("collection").agg(F.sum("tokens").cast("long").alias("_tokens"))
    w = told.groupBy("collection").agg(F.count("*").alias("_warnings"))
    return about.join(n, "collection").join(t, "collection").join(w, "collection", "left").withColumn("_warnings", F.coalesce("_warnings", F.lit(0).cast("long")))


def part_lines(parts: DataFrame) -> DataFrame:
    return parts.select(_name(F.col("filename")), F.lit(0).alias("section"), F.lit(0).cast("long").alias("item"), "text")


def readme_lines(documents: DataFrame, parts: DataFrame, warnings: DataFrame, about: DataFrame) -> DataFrame:
    d, told = _noted(documents), all_warnings(documents, warnings)
    total = _totals(d, parts, told, about)
    heading = F.concat_ws(
        "\n", F.concat(F.lit("# "), F.coalesce("title", "collection"), F.lit("\n")), F.when(F.col("description") != "", F.concat("description", F.lit("\n"))), F.format_string("- **Videos:** %d", "_videos"),
        F.concat(F.lit("- **Total length:** "), hms("_seconds")), F.format_string("- **Size:** about %,d tokens (an estimate)\n", "_tokens"), F.lit(TOLD),
    )
    mark = F.coalesce(F.concat(F.lit(" — **"), "warning_label", F.lit("**")), F.lit(""))
    detail = F.coalesce(F.concat(F.lit("   - "), F.nullif("warning_detail", F.lit("")), F.lit("\n")), F.lit(""))
    line = F.concat(F.format_string("%d. **", F.col("_place")), "name", F.lit("** ("), hms("seconds"), F.format_string(", version %d)", F.col("version").cast("long")), mark, F.lit("\n"), detail)
    part = F.concat(F.lit("- `"), "filename", F.lit("` — "), F.coalesce(F.nullif(F.array_join("documents", ", "), F.lit("")), F.lit("index")), F.format_string(" (about %,d tokens)\n", F.col("tokens").cast("long")))
    some = F.col("_warnings") > 0
    return _joined([
        _fixed(total, README, s0=heading, s2=F.lit(PARTS), s4=F.when(some, F.lit("\n" + WORTH_KNOWING)).otherwise("\n"), s6=F.concat(F.when(some, F.lit("\n")).otherwise(""), F.lit(SIZES + VERSIONS))),
        _lines(placed(d), README, 1, "_place", line), _lines(parts, README, 3, "part", part), _lines(told, README, 5, "place", F.concat(F.lit("- "), "warning", F.lit("\n"))),
    ])


def placed(documents: DataFrame) -> DataFrame:
    """documents with `_place`, from 1 in order of sequence: places of blocks of sequences and places within them, so that no task sees a whole collection."""
    from pyspark.sql import Window

    block = F.floor(F.col("sequence") / 4096)
    held = documents.groupBy("collection", block.alias("_block")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("collection").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("collection", "_block").orderBy("sequence"))
    return documents.withColumn("_block", block).withColumn("_in", inside).join(held.select("collection", "_block", before.alias("_before")), ["collection", "_block"]).withColumn("_place", F.col("_before") + F.col("_in")).drop("_block", "_in", "_before")


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})


def _number(x: Column) -> Column:
    """A double in JSON, in full where Spark writes 1.05E7 and other writers of JSON 10500000.0."""
    size = F.abs(x)
    full = F.regexp_replace(x.cast("decimal(38,21)").cast("string"), r"(\.\d+?)0*$", "$1")
    return F.when(((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3)), full).otherwise(F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", ""))


def _json_with(before: Column, name: str, number: Column, after: Column) -> Column:
    """Two JSON objects as one, with a number between them; the first ends with a number or a null."""
    return F.concat(F.rtrim(before, F.lit("}")), F.lit(f',"{name}":'), _number(number), F.lit(","), F.ltrim(after, F.lit("{")))


def manifest_lines(documents: DataFrame, parts: DataFrame, warnings: DataFrame, about: DataFrame, checksums: DataFrame) -> DataFrame:
    """The lines are one JSON object: what was built, warnings, sources and, as output_checksums, a map of
    files' names to their SHA-256. checksums: name (as in lines), sha256."""
    d, told = _noted(documents), all_warnings(documents, warnings)
    total = _totals(d, parts, told, about).join(parts.groupBy("collection").agg(F.count("*").alias("_parts")), "collection")
    text = lambda x: F.lit(x)
    head = _json_with(
        _json(version=text(1), collection=F.col("collection"), name=F.coalesce("title", "collection"), description=F.col("description"), mode=text("packs"), built_at=F.col("built_at"), video_count=F.col("_videos")),
        "total_duration_seconds", F.bround("_seconds", 3),
        _json(
            total_tokens_estimate=F.col("_tokens"), token_method=text(METHODS["token_method"][0]), token_method_version=text(METHODS["token_method"][1]),
            token_limit=F.col("token_limit"), reserve_tokens=F.col("reserve_tokens"), usable_budget=usable_budget("token_limit", F.coalesce("reserve_tokens", F.lit(0))), allow_video_split=F.col("allow_split"),
            packing_algorithm=text(METHODS["packing"][0]), packing_version=text(METHODS["packing"][1]), pack_count=F.col("_parts"), warning_count=F.col("_warnings"),
        ),
    )
    source = _json_with(
        _json(sequence=F.col("_place"), doc_id=F.col("doc_id"), display_name=F.col("name"), processed_version=F.col("version").cast("long")), "duration_seconds", F.col("seconds"),
        _json(warning=F.coalesce("warning_label", F.lit("")), warning_detail=F.coalesce("warning_detail", F.lit(""))),
    )
    string = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    sums = checksums.withColumn("collection", F.url_decode(F.substring_index("name", "/", 1))).withColumn("file", F.substring_index("name", "/", -1))
    comma = lambda first, rest: F.concat(F.when(first, F.lit("\n")).otherwise(",\n"), rest)
    # parts are numbered from 1, and the readme comes after them
    order = sums.join(parts.select("collection", F.col("filename").alias("file"), "part"), ["collection", "file"], "left").withColumn("part", F.coalesce("part", F.lit(2**31 - 1)))
    first = told.groupBy("collection").agg(F.min("place").alias("_first"))
    return _joined([
        _fixed(total, MANIFEST, s0=F.concat(F.rtrim(head, F.lit("}")), F.lit(',\n"warnings":[')), s2=F.lit('],\n"sources":['), s4=F.lit('],\n"output_checksums":{'), s6=F.lit("}}\n")), _lines(told.join(first, "collection"), MANIFEST, 1, "place", comma(F.col("place") == F.col("_first"), string(F.col("warning")))),
        _lines(placed(d), MANIFEST, 3, "_place", comma(F.col("_place") == 1, source)),
        _lines(order, MANIFEST, 5, "part", comma(F.col("part") == 1, F.concat(string(F.col("file")), F.lit(":"), string(F.col("sha256"))))),
    ])


def files(documents: DataFrame, parts: DataFrame, warnings: DataFrame, about: DataFrame) -> DataFrame:
    """All lines of all files of a build; the manifest's checksums are those of the files that write_texts makes."""
    documents, parts, warnings = written(_noted(documents).drop("text")), written(parts), written(warnings)  # each is read by several files
    texts = readme_lines(documents, parts, warnings, about)
    sums = text_files.digests(texts).unionByName(parts.select(_name(F.col("filename")), "sha256"))
    return _joined([part_lines(parts), texts, manifest_lines(documents, parts, warnings, about, sums)])


def write(documents: DataFrame, parts: DataFrame, warnings: DataFrame, about: DataFrame, path: str) -> None:
    """A build in a folder of its own, below it a folder for each collection; complete, or not there."""
    text_files.write_texts(files(documents, parts, warnings, about), path)
