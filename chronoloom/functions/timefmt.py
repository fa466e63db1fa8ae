"""Time, size and duration labels as column expressions. "Now" is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _long(x: Column) -> Column:
    return x.cast("double").cast("long")


def hms(seconds) -> Column:
    """HH:MM:SS, fractions cut off; hours may pass 99."""
    s = _long(_c(seconds))
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def hms_rounded(seconds) -> Column:
    """HH:MM:SS of the nearest second, halves to even."""
    return hms(F.bround(_c(seconds).cast("double"), 0))


def file_token(seconds) -> Column:
    return F.replace(hms(seconds), F.lit(":"), F.lit(""))


def picture_name(index, seconds) -> Column:
    """NNNNNN_tHHMMSS.jpg. Usual numbers and times are put together from digits, a fraction of the work of a format."""
    n, s = _c(index).cast("long"), _long(_c(seconds))
    time = s + F.floor(s / 60) * 40 + F.floor(s / 3600) * 4000
    digits = lambda x: F.substring((x + 1_000_000).cast("string"), 2, 6)
    usual = n.between(0, 999_999) & s.between(0, 359_999)
    return F.when(usual, F.concat(digits(n), F.lit("_t"), digits(time), F.lit(".jpg"))).otherwise(F.format_string("%06d_t%s.jpg", n, file_token(seconds)))


def subtitle_time(seconds, mark: str = ",") -> Column:
    """HH:MM:SS,mmm with the milliseconds' halves to even; negative times are 0."""
    ms = _long(F.bround(F.greatest(_c(seconds).cast("double"), F.lit(0.0)) * 1000, 0))
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def clock(seconds) -> Column:
    """M:SS or H:MM:SS; a dash for nothing."""
    s = _c(seconds).cast("double")
    t = _long(s)
    return F.when(s.isNull() | (s <= 0), "—").when(t >= 3600, F.format_string("%d:%02d:%02d", F.floor(t / 3600), F.floor(t / 60) % 60, t % 60)).otherwise(F.format_string("%d:%02d", F.floor(t / 60), t % 60))


def elapsed(seconds) -> Column:
    """5s, 3m 20s, 2h 5m."""
    t = F.greatest(_long(_c(seconds)), F.lit(0))
    return F.when(_c(seconds).isNull(), "—").when(t < 60, F.format_string("%ds", t)).when(t < 3600, F.format_string("%dm %ds", F.floor(t / 60), t % 60)).otherwise(F.format_string("%dh %dm", F.floor(t / 3600), F.floor(t % 3600 / 60)))


def span(seconds) -> Column:
    """A rough duration in words: halves of hours below ten hours."""
    s = _c(seconds).cast("double")
    t = _long(s)
    minutes = F.floor(t / 60)
    hours = minutes / 60
    half = F.bround(hours * 2, 0) / 2
    whole = F.floor(half)
    return (
        F.when(s.isNull() | (s <= 0), "a moment")
        .when(t < 90, "under a minute")
        .when(minutes < 60, F.format_string("%d minutes", minutes))
        .when(hours < 2, "about an hour")
        .when(hours < 10, F.when(half == whole, F.format_string("about %d hours", whole)).otherwise(F.format_string("about %d½ hours", whole)))
        .otherwise(F.format_string("about %d hours", _long(F.bround(hours, 0))))
    )


def relative(age_seconds) -> Column:
    """How long ago, in words, from an age in seconds."""
    d = _c(age_seconds).cast("double")
    whole = lambda n: _long(F.floor(d / n))
    return (
        F.when(d.isNull(), "—")
        .when(d < 0, "just now")
        .when(d < 45, F.format_string("%d seconds ago", _long(d)))
        .when(d < 90, "a minute ago")
        .when(d < 3600, F.format_string("%d minutes ago", whole(60)))
        .when(d < 7200, "an hour ago")
        .when(d < 86400, F.format_string("%d hours ago", whole(3600)))
        .when(d < 172800, "yesterday")
        .otherwise(F.format_string("%d days ago", whole(86400)))
    )


def byte_label(size, largest: str = "TB") -> Column:
    """1.5 GB, 12 bytes; a dash for nothing. largest: the biggest unit in use."""
    s = _c(size).cast("double")
    out = F.when(s.isNull() | (s <= 0), "—")
    for unit, power in (("TB", 4), ("GB", 3), ("MB", 2), ("KB", 1)):
        if unit != "TB" or largest == "TB":
            out = out.when(s >= 1024**power, F.format_string(f"%.1f {unit}", F.bround(s / 1024**power, 1)))
    return out.otherwise(F.format_string("%d bytes", _long(s)))


def rough_duration(seconds) -> Column:
    """about 12 minutes, about 3.5 hours; null stays null."""
    s = _c(seconds).cast("double")
    minutes, hours = s / 60, s / 3600
    half = F.bround(hours * 2, 0) / 2
    words = F.when(half == F.floor(half), _long(half).cast("string")).otherwise(F.format_string("%.1f", half))
    return (
        F.when(s.isNull() | (s <= 0), F.lit(None).cast("string"))
        .when(s < 90, "under 2 minutes")
        .when(minutes < 60, F.format_string("about %d minutes", _long(F.bround(minutes, 0))))
        .when(hours < 10, F.concat(F.lit("about "), words, F.lit(" hours")))
        .otherwise(F.format_string("about %d hours", _long(F.bround(hours, 0))))
    )


def parse_time(text) -> Column:
    """Seconds of H:M:S, M:S or S: null for anything else (more parts, signs, no numbers,
    or 60 and more after the first part)."""
    parts = F.split(F.trim(_c(text)), ":")
    numbers = F.transform(parts, lambda p: F.trim(p).try_cast("double"))
    fine = (F.size(parts) <= 3) & F.forall(numbers, lambda x: F.coalesce(x >= 0, F.lit(False))) & F.forall(F.slice(numbers, 2, 3), lambda x: F.coalesce(x < 60, F.lit(False)))
    return F.when(fine, F.aggregate(numbers, F.lit(0.0), lambda a, x: a * 60 + x))


def remaining(age_seconds, done, total, carried) -> Column:
    """What is left, in words, from work done by this run; empty while too little is known."""
    age, done, total = _c(age_seconds).cast("double"), _c(done).cast("double"), _c(total).cast("double")
    performed = done - F.greatest(F.coalesce(_c(carried).cast("double"), F.lit(0.0)), F.lit(0.0))
    left = age / performed * (total - done)
    quiet = age.isNull() | (age < 45) | total.isNull() | (total == 0) | (done <= 0) | (done >= total) | (performed <= 0)
    return F.when(F.coalesce(quiet, F.lit(True)), "").when(left < 30, "nearly done").otherwise(F.concat(span(left), F.lit(" left")))
