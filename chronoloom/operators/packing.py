"""Fitting documents into parts of a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import CHARS_PER_TOKEN, strip, token_estimate
from ..functions.timefmt import hms
from .chains import starts

# Fixed values of the packing rules.
OVERHEAD_TOKENS = 200
OVERLAP = 2_000
MARGIN = 4_000
HEADING = "\n── "


def usable_budget(limit, reserve) -> F.Column:
    return F.greatest(F.lit(0), F.coalesce(F.col(limit) if isinstance(limit, str) else F.lit(limit), F.lit(0)) - F.lit(reserve))


def costs(documents: DataFrame, wrapper_chars: int = 0) -> DataFrame:
    """documents with `tokens`: the wrapped text's estimate and the overhead of a part."""
    return documents.withColumn("tokens", token_estimate(F.length("text") + wrapper_chars) + OVERHEAD_TOKENS)


def next_fit(costed: DataFrame, budget: int | Column) -> DataFrame:
    """collection, sequence, tokens to part numbers, in order: a document opens a new part
    when it doesn't fit the open one; one that fits none has a part of its own (oversized).
    With columns piece and alone, rows are pieces of documents, and those marked alone share no part.
    budget: one number, or a column with one number a collection (above 0).

    Where a part begins depends on all documents before; `chains` settles that without one
    task that sees a whole collection."""
    if not isinstance(budget, Column) and budget <= 0:
        raise ValueError("the usable size is zero or less")
    piece = "piece" in costed.columns
    most = budget if isinstance(budget, Column) else F.lit(budget)
    rows = costed.select(
        "collection", F.col("sequence").cast("long").alias("sequence"), (F.col("piece") if piece else F.lit(0)).cast("int").alias("piece"),
        F.col("tokens").cast("long").alias("tokens"), (F.col("alone") if piece else F.lit(False)).alias("alone"), most.cast("long").alias("budget"),
    )
    big = F.col("tokens") > F.col("budget")
    placed = starts(rows, "collection", ["sequence", "piece"], F.col("tokens"), F.col("budget"), F.col("alone") | big)
    placed = placed.select("collection", "sequence", "piece", F.col("_number").alias("part"), big.alias("oversized"))
    return placed if piece else placed.drop("piece")


def cut_text(text: str, most: int) -> list[str]:
    """Pieces of at most `most` characters: cut before the last heading, else the last blank
    line, else the last line break, else anywhere; never at the very start."""
    if most <= 0:
        raise ValueError("a piece needs at least one character")
    out = []
    while len(text) > most:
        at = next((k for mark in (HEADING, "\n\n", "\n") if (k := text.rfind(mark, 0, most)) > 0), most)
        out.append(text[:at])
        text = text[at:]
    return [*out, text] if not out or text.strip() else out


def split_sections(documents: DataFrame, most, overlap: int = OVERLAP) -> DataFrame:
    """documents (key, text) to pieces of at most `most` (a number, or a column of them) characters: key, piece (from 1), pieces, chunk, overlap (the end
    of the piece before). Cutting depends on the cut before, so one text is one Python call."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for key, text, limit in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                chunks = cut_text(text or "", limit)
                rows += [(key, k, len(chunks), c, chunks[k - 2][-overlap:] if k > 1 and overlap else "") for k, c in enumerate(chunks, 1)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["key", "piece", "pieces", "chunk", "overlap"])

    kind = documents.schema["key"].dataType.simpleString()
    limit = most if isinstance(most, Column) else F.lit(most)
    return documents.select("key", "text", limit.cast("int").alias("most")).mapInArrow(run, f"key {kind}, piece int, pieces int, chunk string, overlap string")


# What stands around the end of the part before.
CONTINUES = ("  <continues_from_previous_part>\n", "\n  </continues_from_previous_part>\n\n")


def split_parts(documents: DataFrame, budget_tokens: int, header_chars: int) -> DataFrame:
    """Documents (key, text) that are too long for one part, cut to a budget less the header and a
    margin: key, part, of, body (which opens with the end of the part before, on purpose) and
    overlap_characters."""
    most = int(budget_tokens * CHARS_PER_TOKEN) - header_chars - MARGIN
    if most <= 0:
        raise ValueError("the budget leaves no room for any text")
    x = split_sections(documents, most)
    body = F.when(F.col("overlap") == "", F.col("chunk")).otherwise(F.concat(F.lit(CONTINUES[0]), F.col("overlap"), F.lit(CONTINUES[1]), F.col("chunk")))
    return x.select("key", F.col("piece").alias("part"), F.col("pieces").alias("of"), F.rtrim(body, F.lit("\n")).alias("body"), F.length("overlap").alias("overlap_characters"))


def pack_manifest(packed: DataFrame, costed: DataFrame) -> DataFrame:
    """Per part: documents, tokens and whether it is oversized."""
    return packed.join(costed.select("collection", F.col("sequence").cast("long").alias("sequence"), "tokens"), ["collection", "sequence"]).groupBy("collection", "part").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.max("oversized").alias("oversized"))


# Wording and layout of collections' documents and parts.
RULE = "=" * 72
ORDERED = "The videos appear in the order you set. Each {} a clear"
BOUNDARY = "boundary so a reader knows where one ends and the next begins."
FOOTER = "\n</video>\n"
READ_IN_ORDER = ("Read the parts in order. Each is a slice of one collection, and the", "boundaries below say exactly which video and which version each piece", "came from.")
CUT_NOTE = " was too long for one part, so it was cut at a natural break. The opening repeats the end of the previous part on purpose."


def _opening(*more: Column) -> Column:
    tag = F.format_string('<video sequence="%d" source_video_id="%s" processed_version="%d"', F.col("sequence").cast("long"), F.col("doc_id").cast("string"), F.col("version").cast("long"))
    return F.concat(tag, *more, F.lit(">\n  <title>"), F.col("name"), F.lit("</title>\n  <duration>"), hms("seconds"), F.lit("</duration>\n"))


def _body(c) -> Column:
    return F.rtrim(F.coalesce(c, F.lit("")), F.lit("\n"))


def full_document_lines(documents: DataFrame, collections: DataFrame) -> DataFrame:
    """collection, sequence, part, line: the lines in order, with a break after each, are a collection's
    document. documents: collection, sequence (from 1), doc_id, name, version, seconds, note (null for
    none), text; collections: collection, title, description (null for none), warnings (their number;
    null in the document of a job, which doesn't count them). Row 0 is the header."""
    n = documents.groupBy("collection").agg(F.count("*").alias("n"), F.sum("seconds").alias("length"))
    job = F.col("warnings").isNull()
    head = F.concat_ws(
        "\n", F.lit(RULE), F.col("title"), F.lit(RULE), F.when(F.col("description") != "", F.concat("description", F.lit("\n"))), F.format_string("Videos            %d", "n"), F.concat(F.lit("Total length      "), hms("length")),
        F.format_string("Warnings          %d", "warnings"), F.lit(""), F.when(job, ORDERED.format("one is marked with")).otherwise(ORDERED.format("is wrapped in")), F.lit(BOUNDARY), F.lit(""),
    )
    head = F.when(job, F.regexp_replace(head, "(?m)^Warnings          .*\n", "")).otherwise(head)
    first = collections.join(n, "collection").select("collection", F.lit(0).cast("long").alias("sequence"), F.lit(0).alias("part"), head.alias("line"))
    row = lambda part, line: documents.select("collection", F.col("sequence").cast("long").alias("sequence"), F.lit(part).alias("part"), line.alias("line"))
    note = F.coalesce(F.concat(F.lit("  <note>"), F.col("note"), F.lit("</note>\n")), F.lit(""))
    return first.unionByName(row(0, F.concat(F.lit("\n"), _opening(), note))).unionByName(row(1, _body("text"))).unionByName(row(2, F.lit("</video>\n")))


def units(documents: DataFrame, budget: int, allow_split: bool = False) -> DataFrame:
    """Documents with their boundaries (as in full_document_lines) as the pieces that parts are made of:
    collection, sequence, piece (0 for a whole one), of, name, text, tokens, alone, overlap_characters.
    A document beyond the budget stays whole, or is cut at sections where allow_split is set."""
    if budget <= 0 or (allow_split and int(budget * CHARS_PER_TOKEN) <= MARGIN):
        raise ValueError("the budget leaves no room for any text")
    open_ = F.concat(F.lit("\n"), _opening(), F.lit("\n"))
    d = documents.withColumn("_whole", F.concat(open_, _body("text"), F.lit(FOOTER))).withColumn("tokens", token_estimate(F.length("_whole")) + OVERHEAD_TOKENS)
    fits = d if not allow_split else d.where(F.col("tokens") <= budget)
    long = lambda c: F.col(c).cast("long").alias(c)
    out = fits.select("collection", long("sequence"), F.lit(0).alias("piece"), F.lit(0).alias("of"), "name", F.col("_whole").alias("text"), "tokens", (F.col("tokens") > budget).alias("alone"), F.lit(0).alias("overlap_characters"))
    if not allow_split:
        return out
    key = F.struct("collection", long("sequence"), F.col("doc_id").cast("string").alias("doc_id"), "name", long("version"), F.col("seconds").cast("double").alias("seconds"))
    cut = split_sections(d.where(F.col("tokens") > budget).select(key.alias("key"), "text", open_.alias("_open")), F.lit(int(budget * CHARS_PER_TOKEN) - MARGIN) - F.length("_open")).select("key.*", "piece", "pieces", "chunk", "overlap")
    numbered = F.format_string(' part="%d" of="%d"', "piece", "pieces")
    body = F.when(F.col("overlap") == "", F.col("chunk")).otherwise(F.concat(F.lit(CONTINUES[0]), F.col("overlap"), F.lit(CONTINUES[1]), F.col("chunk")))
    cut = cut.withColumn("text", F.concat(F.lit("\n"), _opening(numbered), F.lit("\n"), _body(body), F.lit(FOOTER)))
    return out.unionByName(cut.select("collection", "sequence", "piece", F.col("pieces").alias("of"), "name", "text", (token_estimate(F.length("text")) + OVERHEAD_TOKENS).alias("tokens"), F.lit(True).alias("alone"), F.length("overlap").alias("overlap_characters")))


def render_parts(pieces: DataFrame, budget: int, target: str | None = None) -> DataFrame:
    """One Markdown text for each part of each collection: collection, part, parts, filename, documents
    (names in order), tokens, boundaries, text, sha256. Only numbers go through the ordered walk; a
    part's text is bounded by the budget, or is a single piece's."""
    placed = next_fit(pieces, budget)
    of = placed.groupBy("collection").agg(F.max("part").alias("parts"))
    shown = F.when(F.col("piece") > 0, F.format_string("%s (part %d)", "name", "piece")).otherwise(F.col("name"))
    kept = F.struct("sequence", "piece", shown.alias("shown"), "of", "overlap_characters", "oversized", "text")
    x = pieces.join(placed, ["collection", "sequence", "piece"]).groupBy("collection", "part").agg(
        F.array_sort(F.collect_list(kept)).alias("_all"), F.sum("tokens").alias("tokens"), F.max(F.when(F.col("piece") > 0, F.concat("name", F.lit(CUT_NOTE)))).alias("_note")
    )
    x = x.join(of, "collection").withColumn("documents", F.col("_all.shown")).withColumn("filename", F.format_string("collection-pack-%03d.md", "part"))
    text = F.concat_ws(
        "\n", F.format_string("# %s — part %d of %d\n", "collection", "part", "parts"), F.concat(F.lit("- **Contains:** "), F.array_join("documents", ", ")), F.format_string("- **Size:** about %,d tokens (an estimate)", "tokens"),
        F.lit(f"- **Sized for:** {target}") if target else F.lit(None).cast("string"), F.concat(F.lit("- **Note:** "), F.col("_note")), F.lit(""), *map(F.lit, READ_IN_ORDER), F.lit("\n---\n"), strip(F.array_join("_all.text", "")), F.lit(""),
    )
    bounds = F.transform("_all", lambda u: F.struct(u["sequence"].alias("sequence"), (u["piece"] > 0).alias("split"), u["piece"].alias("part"), u["of"].alias("of"), u["overlap_characters"].alias("overlap_characters"), u["oversized"].alias("oversized")))
    return x.select("collection", "part", "parts", "filename", "documents", "tokens", bounds.alias("boundaries"), text.alias("text")).withColumn("sha256", F.sha2("text", 256))


def part_warnings(pieces: DataFrame, budget: int) -> DataFrame:
    """collection, sequence, warning: documents that were cut or stand in a part beyond the budget."""
    big = F.concat(F.col("name"), F.format_string(f" is too big to fit in one part (about %,d tokens against a budget of {budget:,}). It has been placed in a part of its own, which will be over the limit. Allow splitting, or raise the limit, to avoid this.", "tokens"))
    cut = F.format_string("%s was split across %d parts at section boundaries, with an overlap between them.", "name", "of")
    text = F.when(F.col("piece") == 1, cut).when((F.col("piece") == 0) & F.col("alone"), big)
    return pieces.select("collection", "sequence", text.alias("warning")).where("warning is not null")


def build_record(documents: DataFrame, parts: DataFrame, warnings: DataFrame) -> DataFrame:
    """One row for each built collection: documents, seconds, tokens, parts, warnings and a digest over
    the parts' names and digests in order; a collection without documents has none."""
    d = documents.groupBy("collection").agg(F.count("*").alias("documents"), F.bround(F.sum("seconds"), 3).alias("seconds"))
    line = F.concat("filename", F.lit(" "), F.col("sha256"))
    p = parts.groupBy("collection").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("parts"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("part", line.alias("line"))))["line"], "\n"), 256).alias("checksums"))
    w = warnings.groupBy("collection").agg(F.count("*").alias("warnings"))
    return d.join(p, "collection").join(w, "collection", "left").withColumn("warnings", F.coalesce("warnings", F.lit(0).cast("long")))
