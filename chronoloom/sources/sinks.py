"""Writers: redacted JSON lines with digests, and artifact registers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.redact import redact
from ..operators.state import upsert


def redacted_json(rows: DataFrame, *columns: str) -> DataFrame:
    """One redacted JSON text for each row and its SHA-256."""
    text = redact(F.to_json(F.struct(*(columns or rows.columns))))
    return rows.select(text.alias("json")).withColumn("sha256", F.sha2("json", 256))


def write_json(rows: DataFrame, path: str, *columns: str) -> None:
    """Redacted before anything is written; Spark's committer makes the write atomic."""
    redacted_json(rows, *columns).select(F.col("json").alias("value")).write.text(path)


def register(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Artifacts (path, kind, size, sha256, created_at): the first kind stays, the rest is the latest."""
    return upsert(existing, new.where("path is not null"), "path", "created_at", ("kind",))


def verified(registered: DataFrame, present: DataFrame) -> DataFrame:
    """path, problem: missing, changed or null; a file without a registered digest passes."""
    both = registered.select("path", "sha256").join(present.select("path", F.col("sha256").alias("now"), F.lit(True).alias("there")), "path", "left")
    problem: Column = F.when(F.col("there").isNull(), "missing").when(F.col("sha256").isNotNull() & (F.col("sha256") != F.col("now")), "changed")
    return both.select("path", problem.alias("problem"))


def write_collections(parts: DataFrame, record: DataFrame, warnings: DataFrame, path: str) -> None:
    """A build: every part as a text in a folder of its collection and name, digests and boundaries
    beside them, warnings, and the record last, so that a folder with a record is complete."""
    value = F.left("text", F.length("text") - 1)  # the writer puts the last break back
    parts.select("collection", "filename", value.alias("value")).write.partitionBy("collection", "filename").text(f"{path}/parts")
    parts.drop("text").write.json(f"{path}/manifest")
    warnings.write.json(f"{path}/warnings")
    record.write.json(f"{path}/record")


# The groups that can be removed, and the names in a video's folder that belong to each.
GROUPS = (
    ("audio", ("audio.wav",)), ("api_frames", ("frames_api",)), ("frames", ("frames",)), ("descriptions", ("batches", "visual_results.json", "gaps.txt")),
    ("transcript", ("transcript.json", "transcript.txt", "silence_windows.json")),
)


def group_sizes(files: DataFrame) -> DataFrame:
    """Bytes and files of each removable group of videos' folders; other files are in none."""
    parts = F.split("path", "/")
    group = F.coalesce(*[F.when(F.arrays_overlap(parts, F.array(*map(F.lit, names))), name) for name, names in GROUPS])
    return files.select(group.alias("group"), "size").where("group is not null").groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("files"))
