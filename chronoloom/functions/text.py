"""Text, token and label expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F

UNKNOWN = "Unknown"
# Fixed values of the estimates and labels below.
CHARS_PER_TOKEN = 3.6
SLUG_LENGTH = 60
PREVIEW_CHARS = 262_144
HIGH_WORDS = ("high", "certain", "confident", "very high")
MEDIUM_WORDS = ("medium", "moderate", "fairly sure", "fair")
LOW_WORDS = ("low", "unsure", "uncertain", "very low")
TRANSIENT_STATUS = (408, 409, 425, 429, 500, 502, 503, 504, 529)
VIDEO_EXTENSIONS = ("mp4", "webm", "mov")
NUMBER = r"^[+-]?(?:(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:e[+-]?\d+(?:_\d+)*)?|inf|infinity)$"
RESERVED_NAMES = {"con", "prn", "aux", "nul", *(f"com{k}" for k in range(1, 10)), *(f"lpt{k}" for k in range(1, 10))}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# The characters that count as blanks at a text's ends.
BLANKS = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c) -> Column:
    return F.trim(_c(c), F.lit(BLANKS))


def readable(c) -> Column:
    """Neither missing, empty nor the sentinel: never null."""
    c = _c(c)
    return F.coalesce((c != "") & (c != UNKNOWN), F.lit(False))


def token_estimate(chars) -> Column:
    """Characters over 3.6, halves to even."""
    return F.greatest(F.bround(_c(chars) / F.lit(CHARS_PER_TOKEN), 0).cast("long"), F.lit(0))


def confidence(value) -> Column:
    """High, Medium or Low from words or numbers (percent above 1); anything else is Low."""
    t = F.lower(strip(_c(value).cast("string")))
    n = F.when(t.rlike(NUMBER), F.replace(t, F.lit("_"), F.lit("")).try_cast("double"))
    n = F.when(n > 1.0, n / 100.0).otherwise(n)
    return (
        F.when(t.isin(*HIGH_WORDS), "High").when(t.isin(*MEDIUM_WORDS), "Medium").when(t.isin(*LOW_WORDS), "Low")
        .when(n >= 0.8, "High").when(n >= 0.5, "Medium").otherwise("Low")
    )


def picture_label(value) -> Column:
    """1, 01, IDX 01 and idx_1 are one label of two digits or more; null for anything else."""
    t = F.regexp_replace(F.regexp_replace(F.upper(strip(_c(value).cast("string"))), "^IDX", ""), "^[ _:-]+|[ _:-]+$", "")
    n = strip(t).try_cast("bigint")
    return F.when(n.isNotNull(), F.when(F.abs(n) > 99, n.cast("string")).otherwise(F.format_string("%02d", n)))


def file_name(path) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def extension(path) -> Column:
    return F.lower(F.regexp_extract(_c(path), r"\.([^./]*)$", 1))


def stretch_title(instrument, timeframe) -> Column:
    """A · B, either one, or a word for neither."""
    both = F.concat_ws(" · ", *[F.when(readable(c), _c(c)) for c in (instrument, timeframe)])
    return F.coalesce(F.nullif(both, F.lit("")), F.lit("Unlabelled stretch"))


def switch_label(from_a, to_a, from_b, to_b) -> Column:
    a = F.coalesce(_c(from_a) != _c(to_a), F.lit(True))
    b = F.coalesce(_c(from_b) != _c(to_b), F.lit(True))
    return F.when(a & b, F.concat(_c(to_a), F.lit(" · "), _c(to_b))).when(a, _c(to_a)).otherwise(_c(to_b))


def short_hash(text) -> Column:
    return F.substring(F.sha2(_c(text), 256), 1, 16)


def preview(text, most: int = PREVIEW_CHARS) -> tuple[Column, Column]:
    """(the first characters, whether any were cut)."""
    return F.substring(_c(text), 1, most), F.length(_c(text)) > most


def backoff(attempt, base: float = 5.0, cap: float = 120.0, jitter: float = 1.0) -> Column:
    """Seconds before another attempt: doubling, capped before and after the jitter."""
    return F.least(F.least(F.lit(base) * F.pow(F.lit(2.0), _c(attempt) - 1), F.lit(cap)) * F.lit(jitter), F.lit(cap))


def leading_version(text) -> Column:
    """The major version in the first line of `ffmpeg -version`, null where there is none."""
    return F.nullif(F.regexp_extract(_c(text), r"ffmpeg version n?(\d+)\.", 1), F.lit("")).try_cast("int")


def supported(path) -> Column:
    """True for the extensions of videos, in any letter case, behind a name: `.mp4` alone has none."""
    return extension(path).isin(*VIDEO_EXTENSIONS) & ~_c(path).rlike(r"(?:^|/)\.*[^./]*$")


def _plain(name: str | None) -> str | None:
    """ASCII with base letters for accented ones; blanks of any kind become a plain one."""
    if name is None:
        return None
    return "".join(" " if c.isspace() else c for c in unicodedata.normalize("NFKD", name) if c.isspace() or c.isascii())


def slug(name) -> Column:
    """Folder-safe name: letters, digits, - and _, at most 60; empty where nothing usable is left.
    Spark has no NFKD: names beyond ASCII go through a pandas UDF first, no others."""

    def run(names: pd.Series) -> pd.Series:
        return names.map(_plain, na_action="ignore")

    name = F.coalesce(_c(name), F.lit(""))
    odd = name.rlike(r"[^\x00-\x7F]")
    plain = F.coalesce(F.pandas_udf(run, "string")(F.when(odd, name)), name)
    dashes = F.regexp_replace(F.regexp_replace(plain, r"[\s\x1C-\x1F.]", "-"), r"[^A-Za-z0-9_-]", "")
    out = F.regexp_replace(F.regexp_replace(F.lower(dashes), "-{2,}", "-"), "^[-_]+|[-_]+$", "")
    out = F.regexp_replace(F.substring(out, 1, SLUG_LENGTH), "[-_]+$", "")
    return F.when(out.isin(*sorted(RESERVED_NAMES)), "").otherwise(out)
